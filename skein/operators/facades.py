"""Action tables over the stores: a name and arguments in, a DataFrame or a text out.

Every facade has `actions`, a mapping of names to its bound methods, so a tool registry, a command line and a test all call the same
thing. Arguments are held to their ranges here; the methods that do the work stay in engine.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import wraps
from hashlib import md5
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph, logs, memory, providers, retrieval, tools
from skein.operators.engine import DocumentIndex, Memory
from skein.sources import files
from skein.sources.store import Store, Transaction


def held(value: float, low: float, high: float):
    """value within [low, high]."""
    return max(low, min(high, value))


class Actions:
    """Something with actions. An unknown one is an error that names those there are."""

    @property
    def actions(self) -> Mapping[str, Callable[..., Any]]:
        raise NotImplementedError

    def run(self, action: str, **arguments: Any) -> Any:
        found = self.actions.get(action.strip().lower())
        if found is None:
            raise ValueError(f"no action {action!r}; there are {', '.join(sorted(self.actions))}")
        return found(**arguments)

    def tool(self, name: str, description: str = "") -> tools.Tool:
        """The facade as one tool of a registry, its action the first argument."""
        options = [tools.Parameter("action", description=" / ".join(self.actions))]
        return tools.Tool(name, lambda action, **more: self.run(action, **more), description, options)


@dataclass
class RetrievalActions(Actions):
    """The document index by name of action."""

    index: DocumentIndex
    convert_file: Callable[[str, bytes], str] | None = None
    preview_chars: int = 300

    @property
    def actions(self) -> Mapping[str, Callable[..., Any]]:
        return {
            "add_file": self.add_file, "add_text": self.index.add_text, "convert": self.convert, "search": self.search, "search_mqe": self.search_variants,
            "search_hyde": self.search_hypothetical, "search_expanded": self.search_expanded, "query": self.answer, "list": self.index.documents,
            "stats": self.index.statistics, "delete": self.index.delete, "clear": self.index.clear, "retrieve": self.retrieve,
        }

    def blocks(self, path: str) -> DataFrame:
        """(path, block, section, content, doc_type, ...) of the files at a path, read by Spark."""
        return files.read_blocks(self.index.spark, path, convert=self.convert_file)

    def add_file(self, path: str) -> int:
        """Adds the files at a path, one document each with its blocks in order; returns their number."""
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "content"))), lambda x: x["content"]), "\n")
        docs = self.blocks(path).groupBy("path", "doc_type").agg(parts.alias("text"))
        named = docs.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("doc_name"), "doc_type", "text")
        self.index.add(named)
        return named.count()

    def convert(self, path: str) -> DataFrame:
        """What add_file would store, without storing it: (path, section, doc_type, preview)."""
        return self.blocks(path).select("path", "section", "doc_type", T.clip(F.col("content"), self.preview_chars).alias("preview"))

    def search(self, query: str, top_k: int = 5, min_score: float = 0.0, where: Column | None = None) -> DataFrame:
        return self.index.search(query, int(held(top_k, 1, 50)), held(min_score, 0.0, 1.0), where)

    def search_variants(self, query: str, top_k: int = 5, n: int = 3) -> DataFrame:
        return self.index.search_variants(query, int(held(top_k, 1, 50)), int(held(n, 1, 10)))

    def search_hypothetical(self, query: str, top_k: int = 5) -> DataFrame:
        return self.index.search_hypothetical(query, int(held(top_k, 1, 50)))

    def search_expanded(self, query: str, top_k: int = 5, n: int = 3, multiplier: int = 4) -> DataFrame:
        return self.index.search_expanded(query, int(held(top_k, 1, 50)), int(held(n, 1, 10)), int(held(multiplier, 1, 20)))

    def answer(self, query: str, top_k: int = 5) -> tuple[str, list[str]]:
        return self.index.answer(query, int(held(top_k, 1, 20)))

    def retrieve(self, query: str, top_k: int = 5, hybrid: bool = True, variants: bool = True, hypothetical: bool = True, clock: Callable[[], float] = time.monotonic) -> tuple[DataFrame, dict[str, float]]:
        """One pass with legs that can be left out, and the seconds of its stages: phrasings, search, fusion.

        All phrasings are one batch of queries. hybrid: the dense leg too, where there is an encoder; without it only sparse results count.
        """
        marks = [("start", clock())]
        texts = [query]
        if variants:
            texts = providers.query_variants(self.index.generator, query)
        if hypothetical:
            texts = list(dict.fromkeys([*texts, providers.hypothetical_answer(self.index.generator, query)]))
        marks.append(("phrasings", clock()))
        asked = self.index.spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
        found = self.index._results(texts) if hybrid else self.index.index.search(asked).withColumn("method", F.lit("tfidf"))
        best = retrieval.top_k(found, 4 * int(held(top_k, 1, 50))).drop("rank")
        marks.append(("search", clock()))
        out = retrieval.rank_fusion(best).orderBy(F.col("score").desc(), "chunk_id").limit(int(held(top_k, 1, 50)))
        rows = self.index.spark.createDataFrame(out.collect(), out.schema)  # top_k rows
        marks.append(("fusion", clock()))
        return self.index._named(rows), {name: at - before for (_, before), (name, at) in zip(marks, marks[1:], strict=False)}


#: Scores of a batch of texts for a query, as a model or a reranker gives them.
Scorer = Callable[[str, Sequence[str]], Sequence[float]]


@dataclass
class MemoryActions(Actions):
    """The memory store by name of action; as_of stands for now."""

    store: Memory
    as_of: Column
    scorer: Scorer | None = None

    @property
    def actions(self) -> Mapping[str, Callable[..., Any]]:
        return {
            "add": self.add, "search": self.search, "rerank": self.rerank, "forget": self.forget, "consolidate": self.store.consolidate, "delete": self.delete,
            "stats": self.stats, "list": self.listed, "replace_all": self.replace_all, "clear": self.clear,
        }

    def add(self, content: str, memory_type: str = "episodic", importance: float | None = None, session_id: str | None = None, file_path: str | None = None, memory_id: str | None = None, ts=None) -> str:
        """Adds one memory and returns its id, which follows from its fields if none is given. An unknown type is an error."""
        if memory_type not in memory.TYPES:
            raise ValueError(f"no memory type {memory_type!r}; there are {', '.join(memory.TYPES)}")
        spark = self.store.spark
        row = spark.createDataFrame([(memory_id, content, memory_type, importance, ts, session_id, None, file_path)], Memory.SCHEMA)
        row = row.withColumn("ts", F.coalesce("ts", self.as_of.cast("timestamp_ntz"))).withColumn("memory_id", F.coalesce("memory_id", T.fingerprint(F.col("memory_type"), F.coalesce("session_id", F.lit("")), F.col("ts").cast("string"), F.col("content"))))
        named = row.collect()
        self.store.add(spark.createDataFrame(named, row.schema))
        return named[0].memory_id

    def search(self, query: str, limit: int = 5, memory_types: Sequence[str] = memory.TYPES, session_id: str | None = None, min_importance: float | None = None) -> DataFrame:
        return self.store.search(query, self.as_of, int(held(limit, 1, 50)), list(memory_types), session_id, min_importance)

    def rerank(self, query: str, limit: int = 5, coarse: int = 15, memory_types: Sequence[str] = memory.TYPES) -> DataFrame:
        """The `coarse` best memories by TF-IDF, in the scorer's order: (memory_id, content, score). Without a scorer the coarse order holds."""
        rows = self.store.rows.where(F.col("memory_type").isin(*memory_types)).select("memory_id", "content")
        score = None if self.scorer is None else lambda texts: self.scorer(query, texts)
        keyed = rows.select(F.xxhash64("memory_id").alias("key"), "memory_id", "content")
        best = retrieval.coarse_to_fine(query, keyed, score, "key", "content", int(held(coarse, 1, 200)), int(held(limit, 1, 50)))
        return best.join(keyed, F.col("chunk_id") == F.col("key")).select("memory_id", "content", "score").orderBy(F.col("score").desc(), "memory_id")

    def forget(self, strategy: str = "mixed", threshold: float = 0.3, max_age_days: float = 30) -> int:
        """Forgets by a strategy and returns how many memories went."""
        before = self.store.rows.count()
        self.store.maintain(self.as_of, strategy, held(threshold, 0.0, 1.0), max_age_days)
        return before - self.store.rows.count()

    def delete(self, memory_ids: Sequence[str]) -> None:
        self.store.tables.replace("memories", self.store.rows.where(~F.col("memory_id").isin(*memory_ids)))

    def replace_all(self, rows: DataFrame, memory_type: str) -> None:
        """The rows take the place of all memories of a type; what is derived from memories is computed from the new snapshot."""
        kept = self.store.rows.where(F.col("memory_type") != memory_type)
        fresh = memory.prepare(rows.withColumn("memory_type", F.lit(memory_type))).select(kept.columns)
        self.store.tables.replace("memories", kept.unionByName(fresh))

    def stats(self) -> DataFrame:
        """Memories by type and for all, with their mean importance."""
        out = self.store.rows.rollup("memory_type").agg(F.count("*").alias("n"), F.avg("importance").alias("mean_importance"))
        return out.withColumn("memory_type", F.coalesce("memory_type", F.lit("all")))

    def listed(self, memory_type: str | None = None, limit: int = 20) -> DataFrame:
        rows = self.store.rows if memory_type is None else self.store.rows.where(F.col("memory_type") == memory_type)
        return rows.orderBy(F.col("ts").desc_nulls_last(), "memory_id").limit(int(held(limit, 1, 100)))

    def clear(self) -> None:
        self.store.tables.drop("memories")


@dataclass
class DialogueMemory:
    """What a dialogue remembers: questions and answers go in, related memories come out as text, and upkeep follows the number of stores.

    Fixed values: every 5th store working memories become episodic (importance 0.6), every 20th episodic ones semantic (0.8), every 10th weak old ones are forgotten.
    """

    actions: MemoryActions
    top_k: int = 3
    threshold: float = 0.5
    memory_type: str = "episodic"
    enabled: bool = True
    stores: int = 0
    cadences: Mapping[str, int] = field(default_factory=lambda: {"consolidate": 5, "deepen": 20, "forget": 10})

    def set_top_k(self, k: int) -> None:
        self.top_k = int(held(k, 1, 20))

    def set_threshold(self, threshold: float) -> None:
        self.threshold = float(held(threshold, 0.0, 1.0))

    def retrieve(self, query: str, top_k: int | None = None, threshold: float | None = None) -> str:
        """Memories of at least a threshold's importance, one a line; empty where there is none or memory is off."""
        if not self.enabled:
            return ""
        found = self.actions.search(query, top_k or self.top_k, min_importance=self.threshold if threshold is None else threshold)
        return "\n".join(f"- {r.content}" for r in found.collect())  # top_k rows

    def store(self, question: str, answer: str, importance: float = 0.5, memory_type: str | None = None) -> list[str]:
        """Stores both, the answer 0.1 more important, and returns what upkeep was due."""
        if not self.enabled:
            return []
        for place, (text, weight) in enumerate(((question, importance), (answer, min(1.0, importance + 0.1)))):
            self.actions.add(text, memory_type or self.memory_type, weight, memory_id=f"d{self.stores}-{place}-{md5(f'{question}|{answer}'.encode()).hexdigest()[:8]}")
        self.stores += 1
        due = [name for name, every in self.cadences.items() if self.stores % every == 0]
        for name in due:
            if name == "forget":
                self.actions.forget("mixed", 0.3, 7)
            else:
                self.promote(*(("working", "episodic", 0.6) if name == "consolidate" else ("episodic", "semantic", 0.8)))
        return due

    def promote(self, source: str, target: str, least: float) -> None:
        """Memories of a type that are important enough become ones of another."""
        store = self.actions.store
        up = (F.col("memory_type") == source) & (F.col("importance") >= least)
        store.tables.replace("memories", store.rows.withColumn("memory_type", F.when(up, F.lit(target)).otherwise(F.col("memory_type"))))


@dataclass
class SemanticStore:
    """Semantic memories with their vectors, the entities that they name and the edges between these: three tables that grow together."""

    tables: Store
    encoder: providers.Encoder | None = None

    def _add(self, t: Transaction, memories: DataFrame) -> None:
        added = t.append("semantic", providers.embed(memories.select("memory_id", "content").dropDuplicates(["memory_id"]), self.encoder, "content"))
        found = graph.mentions(added)
        columns = ["memory_id", "source", "target", "type", "weight"]
        t.append("mentions", found)
        t.append("edges", graph.cooccurrence(found).select(columns).unionByName(graph.pattern_relations(added, found).select(columns)))

    def insert(self, memories: DataFrame) -> None:
        """Adds memories (memory_id, content): vectors, mentions, edges of co-occurrence and of patterns, in one commit. An id that is there already is left as it is."""
        with self.tables.begin() as t:
            known = t.read("semantic")
            self._add(t, memories if known is None else memories.join(known.select("memory_id"), "memory_id", "left_anti"))

    def rebuild(self, memories: DataFrame) -> None:
        """All tables anew from memories, in one commit: what was derived from the old rows goes with them."""
        with self.tables.begin() as t:
            for name in ("semantic", "mentions", "edges"):
                t.drop(name)
            self._add(t, memories)

    def related(self, query: str, limit: int = 10) -> DataFrame:
        """(memory_id, score): memories by the entities of a text and the edges to theirs."""
        found, edges = self.tables.read("mentions"), self.tables.read("edges")
        asked = found.sparkSession.createDataFrame([(0, query)], "memory_id int, content string")
        return graph.graph_scores(graph.mentions(asked).select("key"), found, edges).orderBy(F.col("score").desc(), "memory_id").limit(limit)


def sessions(messages: DataFrame, key: str, ts: str, kind: Column | None = None, limit: int = 50) -> DataFrame:
    """(session, updated_at, created_at, messages): the sessions of a message table, the latest first; kind: which messages count."""
    rows = messages if kind is None else messages.where(kind)
    each = rows.groupBy(F.col(key).alias("session")).agg(F.max(ts).alias("updated_at"), F.min(ts).alias("created_at"), F.count("*").alias("messages"))
    return each.orderBy(F.col("updated_at").desc(), "session").limit(limit)


def guarded(breaker: tools.Breaker, clock: Callable[[], float] = time.monotonic, fallback: Callable[..., Any] | None = None):
    """A decorator: calls go through a breaker; while it refuses them, the fallback answers or an error is raised."""

    def wrap(f: Callable[..., Any]) -> Callable[..., Any]:
        @wraps(f)
        def call(*args: Any, **named: Any) -> Any:
            if not breaker.allows(clock()):
                if fallback is None:
                    raise RuntimeError(f"{f.__name__} is switched off for now")
                return fallback(*args, **named)
            ok = False
            try:
                out = f(*args, **named)
                ok = True
                return out
            finally:
                breaker.record(ok, clock())

        return call

    return wrap


@dataclass
class Policies:
    """Who may use which tools. Every change gives the next table; apply_policy joins it with calls."""

    rules: dict[str, tuple[frozenset[str], frozenset[str]]] = field(default_factory=dict)

    def _with(self, role: str, allow: frozenset[str], deny: frozenset[str]) -> Policies:
        return Policies({**self.rules, role: (allow, deny)})

    def set(self, role: str, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> Policies:
        return self._with(role, frozenset(allow), frozenset(deny))

    def allow(self, role: str, *names: str, replace: bool = False) -> Policies:
        allowed, denied = self.rules.get(role, (frozenset(), frozenset()))
        return self._with(role, frozenset(names) if replace else allowed | set(names), denied)

    def deny(self, role: str, *names: str) -> Policies:
        allowed, denied = self.rules.get(role, (frozenset(), frozenset()))
        return self._with(role, allowed, denied | set(names))

    def allow_all(self, role: str) -> Policies:
        return self.allow(role, "*", replace=True)

    def remove(self, role: str) -> Policies:
        return Policies({k: v for k, v in self.rules.items() if k != role})

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, sorted(a), sorted(d)) for k, (a, d) in sorted(self.rules.items())], "role string, allow array<string>, deny array<string>")

    def statistics(self) -> dict[str, int]:
        return {"roles": len(self.rules), "allowed": sum(len(a) for a, _ in self.rules.values()), "denied": sum(len(d) for _, d in self.rules.values())}


def search_registry(search: Sequence[tuple[str, Callable[[str], list[dict]]]] = (), clock: Callable[[], float] = time.time) -> tools.Registry:
    """A registry with web search over the given providers, arithmetic and the time."""

    def web(query: str, limit: int = 5) -> list[dict]:
        """Searches the web with the first provider that answers."""
        return [vars(x) for x in providers.web_search(search, query, limit)]

    def now() -> str:
        """The time of day, UTC."""
        return time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(clock()))

    registry = tools.Registry()
    for f, name in ((web, "search"), (tools.calculate, "calculator"), (now, "time")):
        registry.register(tools.Tool.of(f, name))
    return registry


def invalidate(cached: Mapping[str, Any], note_id: str) -> dict[str, Any]:
    """What of a cache of texts may stay after a note was written: not its own text, no list or summary, no text that names it."""
    stale = lambda key, value: key == f"note:{note_id}" or key.split(":")[0] in ("list", "summary") or (isinstance(value, str) and note_id in value)
    return {k: v for k, v in cached.items() if not stale(k, v)}


@dataclass(frozen=True)
class ActiveSkills:
    """The skills that are switched on, over a table of skills (name, description, content)."""

    skills: DataFrame
    active: tuple[str, ...] = ()

    def activate(self, *names: str) -> ActiveSkills:
        unknown = set(names) - {r.name for r in self.skills.where(F.col("name").isin(*names)).select("name").collect()}
        if unknown:
            raise ValueError(f"no skill {', '.join(sorted(unknown))}")
        return ActiveSkills(self.skills, tuple(dict.fromkeys([*self.active, *names])))

    def deactivate(self, *names: str) -> ActiveSkills:
        return ActiveSkills(self.skills, tuple(n for n in self.active if n not in names))

    def use(self, name: str) -> DataFrame:
        return self.skills.where(F.col("name") == name)

    def context(self) -> DataFrame:
        from skein.operators.traces import skill_context

        return skill_context(self.skills, self.active)


#: Bytes of a picture or a film that are handed to a vision model.
MEDIA_BYTES = 10 << 20


def describe_media(media: DataFrame, model: Callable[[str, Sequence[bytes]], str], prompt: str, by: str | None = None, most: int = 8) -> DataFrame:
    """(path or by, description) of media (path, content), one call of the model each, or one for up to `most` media of a group.

    Files above MEDIA_BYTES and empty ones are told about, not sent. The model runs where the bytes are, in the executors.
    """
    key = by or "path"
    good = F.coalesce(F.length("content").between(1, MEDIA_BYTES), F.lit(False))
    ranked = media.select(F.col(key).cast("string").alias("key"), "path", F.when(good, F.col("content")).alias("content"))
    first = logs.last_n(ranked, most, "key", "path") if by else ranked

    def call(parts: list[bytes]) -> str:
        sent = [bytes(x) for x in parts if x]
        return model(prompt, sent) if sent else "too large or empty"

    described = F.udf(call, "string")
    return first.groupBy("key").agg(F.collect_list("content").alias("parts")).select(F.col("key").alias(key), described("parts").alias("description"))
