"""Traces of runs: recorded on the driver, flushed as JSON lines, read back as tables. Parsers of models' outputs, skills in use."""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_type string, name string, input string, output string, status string, duration_ms double, error string, ts double"
TRACE = f"trace_id string, agent_name string, agent_type string, session_id string, query string, started_at double, finished_at double, duration_ms double, status string, error string, events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>"


@dataclass
class Event:
    event_type: str
    name: str
    input: str = ""
    output: str = ""
    status: str = "success"
    duration_ms: float = 0.0
    error: str | None = None
    ts: float = 0.0


@dataclass
class Trace:
    trace_id: str
    agent_name: str
    agent_type: str
    session_id: str
    query: str
    started_at: float
    finished_at: float | None = None
    duration_ms: float | None = None
    status: str = "running"
    error: str | None = None
    events: list[Event] = field(default_factory=list)

    def failure_chain(self) -> list[Event]:
        return [e for e in self.events if e.status != "success"]


class Recorder:
    """Open traces are a stack and events go to the top one; finished ones wait in a ring of bounded length until they are flushed."""

    def __init__(self, clock: Callable[[], float], keep: int = 200, clip: int = 2000):
        self.clock, self.clip, self.open, self.done = clock, clip, [], deque(maxlen=keep)

    def _short(self, value: Any) -> str:
        text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
        return text if len(text) <= self.clip else text[: self.clip] + "..."

    def start(self, agent: str, kind: str, query: str, session: str = "") -> Trace:
        trace = Trace(uuid.uuid4().hex, agent, kind, session, self._short(query), self.clock())
        self.open.append(trace)
        return trace

    def log(self, kind: str, name: str, given: Any = "", made: Any = "", status: str = "success", error: str | None = None, ms: float = 0.0) -> None:
        if self.open:
            self.open[-1].events.append(Event(kind, name, self._short(given), self._short(made), status, ms, error, self.clock()))

    def finish(self, status: str = "success", error: str | None = None) -> Trace | None:
        if not self.open:
            return None
        trace = self.open.pop()
        trace.finished_at = self.clock()
        trace.duration_ms, trace.status, trace.error = (trace.finished_at - trace.started_at) * 1000, status, error
        self.done.append(trace)
        return trace

    def hook(self, f: Callable[..., Any], name: str | None = None) -> Callable[..., Any]:
        """f with an event for each call; a hooked function is returned as it is."""
        if getattr(f, "traced", False):
            return f

        @functools.wraps(f)
        def call(*args: Any, **kwargs: Any) -> Any:
            began = self.clock()
            try:
                out = f(*args, **kwargs)
            except Exception as e:
                self.log("call", name or f.__name__, kwargs or list(args), "", "error", str(e), (self.clock() - began) * 1000)
                raise
            self.log("call", name or f.__name__, kwargs or list(args), out, ms=(self.clock() - began) * 1000)
            return out

        call.traced = True
        return call

    def flush(self, spark: SparkSession, path: str) -> int:
        """Finished traces, appended as JSON lines."""
        rows = [asdict(t) for t in self.done]
        if rows:
            spark.createDataFrame(rows, TRACE).coalesce(1).write.mode("append").json(path)
        self.done.clear()
        return len(rows)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces from JSON lines; lines that can't be read are left out."""
    rows = spark.read.schema(TRACE + ", broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.where("broken is null and trace_id is not null").drop("broken")


def summary(traces: DataFrame) -> DataFrame:
    calls = F.size(F.filter("events", lambda e: e["event_type"] == "call"))
    return traces.agg(
        F.count("*").alias("traces"), F.avg((F.col("status") == "success").cast("double")).alias("success_rate"), F.avg("duration_ms").alias("mean_ms"), F.coalesce(F.sum(calls), F.lit(0)).alias("calls")
    )


def recent_failures(traces: DataFrame, n: int = 5) -> DataFrame:
    """The newest failed traces with the events that failed."""
    chain = F.filter("events", lambda e: e["status"] != "success")
    return traces.where("status <> 'success'").orderBy(F.col("started_at").desc(), "trace_id").limit(n).select("trace_id", "query", "error", chain.alias("chain"))


def thought_and_action(text: Column) -> Column:
    """struct(thought, action, input) of "Thought: ... Action: name[input]"."""
    thought = F.regexp_extract(text, r"(?s)Thought\s*[:：]\s*(.*?)(?:\n\s*Action\s*[:：]|$)", 1)
    line = r"(?s)Action\s*[:：]\s*([\w-]+)\s*\[(.*?)\]\s*(?:\n|$)"
    return F.struct(F.trim(thought).alias("thought"), F.regexp_extract(text, line, 1).alias("action"), F.regexp_extract(text, line, 2).alias("input"))


def listed(text: Column) -> Column:
    """A list from a model's output: a JSON array (fenced or not), else its lines without list marks."""
    inside = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:\w+)?\s*(.*?)```", 1), F.lit("")), text)
    parsed = F.from_json(F.regexp_extract(inside, r"(?s)(\[.*\])", 1), "array<string>")
    lines = F.filter(F.transform(F.split(inside, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^(?:\d+[.、)]|[-*•])\s*", "")), lambda x: x != "")
    return F.coalesce(parsed, lines)


def skill_context(skills: DataFrame, active: Sequence[str]) -> DataFrame:
    """One text of the active skills' contents, in the order of their names."""
    chosen = skills.where(F.col("name").isin(*active)) if active else skills.where("false")
    part = F.concat(F.lit("## "), "name", F.lit("\n"), "content")
    return chosen.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))


def command_memories(commands: DataFrame) -> DataFrame:
    """Rows for a memory from a log of commands (seq, command, status): failures weigh more than successes."""
    weight = F.when(F.col("status") == "ok", 0.4).when(F.col("status") == "timeout", 0.7).otherwise(0.8)
    return commands.select(F.concat(F.lit("cmd-"), F.col("seq").cast("string")).alias("memory_id"), F.concat_ws(" ", "command", "status").alias("content"), F.lit("working").alias("memory_type"), weight.alias("importance"))


def terminal_context(commands: DataFrame, state: str, last: int = 5) -> DataFrame:
    """(content, relevance): the state and the last commands."""
    spark = commands.sparkSession
    recent = commands.orderBy(F.col("seq").desc()).limit(last).select(F.concat_ws(" ", "command", "status").alias("content"), F.lit(0.3).alias("relevance"))
    return spark.createDataFrame([(state, 0.6)], "content string, relevance double").unionByName(recent)


def split_reading(text: str) -> tuple[str, str]:
    """Name and rest of a "command rest" line."""
    m = re.match(r"\s*(\S+)\s*(.*)", text, re.S)
    return (m[1], m[2]) if m else ("", "")
