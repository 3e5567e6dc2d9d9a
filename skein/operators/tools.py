"""Registered functions: descriptors, role policies, chains, parallel runs. Everything here runs on the driver and builds plans."""

from __future__ import annotations

import ast
import inspect
import operator
import re
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import local
from typing import Any


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str = "string"
    description: str = ""
    required: bool = True
    default: Any = None


@dataclass
class Result:
    status: str
    output: Any = None
    error: str | None = None
    duration_ms: float = 0.0
    extra: dict = field(default_factory=dict)


@dataclass
class Tool:
    name: str
    run: Callable[..., Any]
    description: str = ""
    parameters: list[Parameter] = field(default_factory=list)

    @classmethod
    def of(cls, f: Callable[..., Any], name: str | None = None) -> Tool:
        """A tool of a plain function: its first docstring line describes it, its signature gives the parameters."""
        kinds = {int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}
        found = [
            Parameter(p.name, kinds.get(p.annotation, "string"), "", p.default is p.empty, None if p.default is p.empty else p.default)
            for p in inspect.signature(f).parameters.values()
            if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)
        ]
        return cls(name or f.__name__, f, (inspect.getdoc(f) or "").split("\n")[0], found)

    def schema(self) -> dict:
        """The JSON schema that describes a call."""
        properties = {p.name: {"type": p.type, "description": p.description} | ({} if p.default is None else {"default": p.default}) for p in self.parameters}
        return {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": properties, "required": [p.name for p in self.parameters if p.required]}}


class Breaker:
    """CLOSED until `failures` in a row, OPEN for `recovery` seconds, then HALF_OPEN for a few trials. Time is an argument, so it can be replayed."""

    def __init__(self, failures: int = 3, recovery: float = 30.0, trials: int = 1):
        self.limit, self.recovery, self.trials = failures, recovery, trials
        self.state, self.failed, self.since, self.tried = "CLOSED", 0, 0.0, 0

    def allows(self, now: float) -> bool:
        if self.state == "OPEN" and now - self.since >= self.recovery:
            self.state, self.tried = "HALF_OPEN", 0
        if self.state == "HALF_OPEN":
            self.tried += 1
            return self.tried <= self.trials
        return self.state == "CLOSED"

    def record(self, ok: bool, now: float) -> None:
        if ok:
            self.state, self.failed = "CLOSED", 0
            return
        self.failed += 1
        if self.state == "HALF_OPEN" or self.failed >= self.limit:
            self.state, self.since = "OPEN", now


class Registry:
    """Tools by name (case does not matter), role policies, breakers and an observer."""

    def __init__(self, observer: Callable[[str, Result], None] | None = None, clock: Callable[[], float] = time.monotonic, max_depth: int = 3):
        self.tools: dict[str, Tool] = {}
        self.policies: dict[str, tuple[set[str], set[str]]] = {}
        self.breakers: dict[str, Breaker] = {}
        self.observer, self.clock, self.max_depth = observer, clock, max_depth
        self._depth = local()

    def register(self, tool: Tool, breaker: Breaker | None = None) -> None:
        self.tools[tool.name.lower()] = tool
        if breaker:
            self.breakers[tool.name.lower()] = breaker

    def register_group(self, makers: Mapping[str, Callable[[], Sequence[Tool]]]) -> dict[str, str]:
        """Tools of several groups; a group that fails is told about and does not stop the others."""
        failed = {}
        for name, make in makers.items():
            try:
                for tool in make():
                    self.register(tool)
            except Exception as e:  # a group's own failure, whatever it is
                failed[name] = str(e)
        return failed

    def find(self, name: str) -> Tool | None:
        return self.tools.get(name.lower())

    def remove(self, name: str) -> bool:
        return self.tools.pop(name.lower(), None) is not None

    def set_policy(self, role: str, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> None:
        self.policies[role] = ({a.lower() for a in allow}, {d.lower() for d in deny})

    def allowed(self, role: str | None, name: str) -> bool:
        """No policy allows everything, deny beats allow, * stands for all."""
        if role is None or role not in self.policies:
            return True
        allow, deny = self.policies[role]
        return not ({name.lower(), "*"} & deny) and bool({name.lower(), "*"} & allow)

    def listed(self, role: str | None = None) -> list[Tool]:
        return [t for k, t in sorted(self.tools.items()) if self.allowed(role, k)]

    def schemas(self, role: str | None = None) -> list[dict]:
        return [t.schema() for t in self.listed(role)]

    def execute(self, name: str, arguments: Mapping[str, Any] | None = None, role: str | None = None) -> Result:
        """Lookup, role, parameters, breaker, run, observer. Failures come back as results."""
        began, depth = time.perf_counter(), getattr(self._depth, "n", 0)
        result = self._run(name, dict(arguments or {}), role, depth)
        result.duration_ms = (time.perf_counter() - began) * 1000
        if self.observer:
            self.observer(name, result)
        return result

    def _run(self, name: str, arguments: dict, role: str | None, depth: int) -> Result:
        tool = self.find(name)
        if tool is None:
            return Result("error", error=f"no tool {name}")
        if not self.allowed(role, name):
            return Result("error", error=f"{role} may not use {name}")
        if depth >= self.max_depth:
            return Result("error", error="calls are nested too deeply")
        for p in tool.parameters:
            if p.name not in arguments:
                if p.required and p.default is None:
                    return Result("error", error=f"parameter {p.name} is missing")
                arguments[p.name] = p.default
        breaker, now = self.breakers.get(name.lower()), self.clock()
        if breaker and not breaker.allows(now):
            return Result("error", error=f"{name} is switched off for now", extra={"breaker": breaker.state})
        self._depth.n = depth + 1
        try:
            out = tool.run(**arguments)
            result = out if isinstance(out, Result) else Result("success", out)
        except Exception as e:  # a tool may fail in any way; the caller gets a result
            result = Result("error", error=f"{type(e).__name__}: {e}")
        finally:
            self._depth.n = depth
        if breaker:
            breaker.record(result.status != "error", self.clock())
        return result


@dataclass(frozen=True)
class Step:
    tool: str
    inputs: Mapping[str, Any]
    output: str


def run_chain(registry: Registry, steps: Sequence[Step], start: Mapping[str, Any], role: str | None = None) -> dict[str, Any]:
    """Steps in order; {name} in an input is replaced by an earlier output (the value itself if it is all there is). A failure stops the chain."""
    known = dict(start)

    def fill(value: Any) -> Any:
        if not isinstance(value, str):
            return value
        whole = re.fullmatch(r"\{(\w+)\}", value)
        if whole and whole[1] in known:
            return known[whole[1]]
        return re.sub(r"\{(\w+)\}", lambda m: str(known.get(m[1], m[0])), value)

    for step in steps:
        result = registry.execute(step.tool, {k: fill(v) for k, v in step.inputs.items()}, role)
        if result.status == "error":
            raise RuntimeError(f"{step.tool}: {result.error}")
        known[step.output] = result.output
    return known


def run_parallel(registry: Registry, calls: Sequence[tuple[str, Mapping[str, Any]]], workers: int = 4, role: str | None = None) -> list[Result]:
    """Independent calls in threads, results in the order of the calls. Spark jobs that they start are scheduled side by side."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda c: registry.execute(c[0], c[1], role), calls))


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def calculate(expression: str) -> float:
    """Numbers with + - * / % ** and signs; anything else is refused, and so are huge powers."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and (abs(b) > 1000 or abs(a) > 1e6):
                raise ValueError("the power is too large")
            return _BINARY[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
            return _UNARY[type(node.op)](value(node.operand))
        raise ValueError(f"not arithmetic: {expression}")

    return value(ast.parse(expression.strip(), mode="eval"))
