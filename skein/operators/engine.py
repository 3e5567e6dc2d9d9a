"""Facades: a document index, a memory and a context builder over tables.

State is a durable store (skein.sources.store): a change is one commit, readers keep the version they began with, and a store that is opened again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import scores as S
from skein.functions import text as T
from skein.operators import chunking, context, memory, providers, retrieval
from skein.operators.segments import TextIndex
from skein.sources.store import Store


class DocumentIndex:
    """Documents in chunks with dense and sparse retrieval.

    The chunk table has (chunk_id, doc_id, doc_name, doc_type, chunk_index, text, tokens, embedding). Postings are an index that grows with it (TextIndex), in the same
    commits, so no search sees one without the other; adding documents reads and indexes these alone.
    """

    def __init__(self, spark: SparkSession, folder: str, encoder: providers.Encoder | None = None, generator: providers.Generator | None = None, limit: int = 200, overlap: int = 30):
        self.spark, self.tables = spark, Store(spark, folder)
        self.encoder, self.generator, self.limit, self.overlap = encoder, generator, limit, overlap
        self.index = TextIndex(self.tables)

    def add(self, docs: DataFrame) -> None:
        """Documents (doc_id long, doc_name, doc_type, text); those of an id that is there already take its place."""
        cut = chunking.token_chunks(docs, "doc_id", "text", self.limit, self.overlap)
        named = cut.withColumnRenamed("id", "doc_id").join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "doc_name", "doc_type"), "doc_id")
        rows = named.select(F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), "doc_id", "doc_name", "doc_type", "chunk_index", F.col("content").alias("text"), "tokens")
        rows = providers.embed(rows, self.encoder)
        with self.tables.begin() as t:
            old = t.read("chunks")
            if old is not None:
                same = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
                self.index.delete(old.join(same, "doc_id", "left_semi").select(F.col("chunk_id").alias("id")), into=t)
                t.append("gone", same.select("doc_id", F.lit(t.base.version + 1).cast("long").alias("since")))
            added = t.append("chunks", rows.withColumn("since", F.lit(t.base.version + 1).cast("long")))
            self.index.add(added, into=t)

    def add_text(self, text: str, title: str, doc_id: int, doc_type: str = "text") -> None:
        self.add(self.spark.createDataFrame([(doc_id, title, doc_type, text)], "doc_id long, doc_name string, doc_type string, text string"))

    @property
    def chunks(self) -> DataFrame:
        """The chunks that count: those of a document that was added again or deleted later don't."""
        rows, gone = self.tables.read("chunks"), self.tables.read("gone")
        if rows is None:
            return self.spark.createDataFrame([], "chunk_id long, doc_id long, doc_name string, doc_type string, chunk_index int, text string, tokens int, embedding array<double>")
        if gone is not None:
            last = gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("since").alias("gone_since"))
            rows = rows.join(last, (F.col("doc_id") == F.col("gone_id")) & (F.col("since") < F.col("gone_since")), "left_anti")
        return rows.drop("since")

    def merge(self, fan: int = 4) -> None:
        """Upkeep: segments and parts of like size become one, and chunks that no longer count go."""
        self.index.merge(fan)
        for name in ("chunks", "gone", "index_terms", "index_facts", "index_dead"):
            self.tables.compact(name, fan)

    def _results(self, queries: Sequence[str], chunks: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, score, method) of a batch of queries: one plan, whatever their number. chunks: those that may be found, if not all."""
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
        sparse = self.index.search(asked, chunks)
        chunks = self.chunks if chunks is None else chunks
        if self.encoder is None:
            return sparse.withColumn("method", F.lit("tfidf"))
        vectors = self.spark.createDataFrame([(i, v) for i, v in enumerate(self.encoder(list(queries))) if v], "query_id int, vector array<double>")
        return retrieval.hybrid(retrieval.dense_search(vectors, chunks.where("embedding is not null")), sparse)

    def _named(self, results: DataFrame) -> DataFrame:
        return results.join(self.chunks.select("chunk_id", "doc_id", "doc_name", "text"), "chunk_id").orderBy(F.col("score").desc(), "chunk_id")

    def search(self, query: str, k: int = 5, min_score: float = 0.0, where: Column | None = None) -> DataFrame:
        k = max(1, min(50, k))
        chosen = None if where is None else self.chunks.where(where)
        return self._named(self._results([query], chosen).where(F.col("score") >= min_score).orderBy(F.col("score").desc(), "chunk_id").limit(k))

    def search_variants(self, query: str, k: int = 5, n: int = 3) -> DataFrame:
        """Several phrasings at once; a chunk that more of them find scores higher."""
        found = retrieval.top_k(self._results(providers.query_variants(self.generator, query, n)), k)
        return self._named(retrieval.multi_query_merge(found.drop("rank")).orderBy(F.col("score").desc(), "chunk_id").limit(k))

    def search_hypothetical(self, query: str, k: int = 5) -> DataFrame:
        """What resembles a made-up answer first, then what the query itself finds."""
        found = retrieval.top_k(self._results([providers.hypothetical_answer(self.generator, query), query]), k).drop("rank")
        union = retrieval.hypothetical_union(found.where("query_id = 0").drop("query_id"), found.where("query_id = 1").drop("query_id"))
        return union.join(self.chunks.select("chunk_id", "doc_id", "doc_name", "text"), "chunk_id").orderBy("position").limit(k)

    def search_expanded(self, query: str, k: int = 5, n: int = 3, multiplier: int = 4) -> DataFrame:
        texts = list(dict.fromkeys([*providers.query_variants(self.generator, query, n), providers.hypothetical_answer(self.generator, query)]))
        return self._named(retrieval.expanded_merge(self._results(texts), max(1, min(50, k)), len(texts), multiplier))

    def answer(self, query: str, k: int = 5) -> tuple[str, list[str]]:
        """A generated answer (or the evidence itself) and the evidence with its numbers."""
        rows = self.search_expanded(query, k).collect()  # k rows at most
        evidence = [f"[{i}] {r.text}" for i, r in enumerate(rows, 1)]
        prompt = "\n".join([*evidence, f"Question: {query}"])
        return (self.generator(prompt) if self.generator else "\n".join(evidence)), evidence

    def documents(self, doc_type: str | None = None) -> DataFrame:
        rows = self.chunks if doc_type is None else self.chunks.where(F.col("doc_type") == doc_type)
        return rows.groupBy("doc_id", "doc_name", "doc_type").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))

    def statistics(self) -> DataFrame:
        """Documents and chunks by type, and a row for all."""
        out = self.documents().rollup("doc_type").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))
        return out.withColumn("doc_type", F.coalesce("doc_type", F.lit("all")))

    def delete(self, doc_ids: Sequence[int]) -> None:
        ids = self.spark.createDataFrame([(int(i),) for i in doc_ids], "doc_id long")
        with self.tables.begin() as t:
            rows = t.read("chunks")
            if rows is not None:
                self.index.delete(rows.join(ids, "doc_id", "left_semi").select(F.col("chunk_id").alias("id")), into=t)
                t.append("gone", ids.withColumn("since", F.lit(t.base.version + 1).cast("long")))

    def clear(self) -> None:
        self.tables.drop(*self.tables.manifest().tables)


class Memory:
    """Memories of four types in one table, partitioned by type, with the type's own score."""

    SCHEMA = "memory_id string, content string, memory_type string, importance double, ts timestamp_ntz, session_id string, modality string, file_path string"

    def __init__(self, spark: SparkSession, folder: str, ttl_minutes: float = 60):
        self.spark, self.tables, self.ttl = spark, Store(spark, folder), ttl_minutes

    @property
    def rows(self) -> DataFrame:
        found = self.tables.read("memories")
        return self.spark.createDataFrame([], self.SCHEMA) if found is None else found

    def add(self, rows: DataFrame) -> None:
        self.tables.append("memories", memory.prepare(rows.select("memory_id", "content", "memory_type", "importance", "ts", "session_id", "modality", "file_path")))
        self.tables.compact("memories")

    def search(self, query: str, as_of: Column, limit: int = 5, types: Sequence[str] = memory.TYPES, session: str | None = None, min_importance: float | None = None) -> DataFrame:
        """(memory_id, content, memory_type, score): TF-IDF and key words by the type's formula, all types in one ranking."""
        rows = memory.prefilter(self.rows.where(F.col("memory_type").isin(*types)), session=session, min_importance=min_importance)
        asked = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        sparse = retrieval.sparse_search(asked, rows.select(F.col("memory_id").alias("chunk_id"), F.col("content").alias("text")), digits=None).select(F.col("chunk_id").alias("memory_id"), F.col("score").alias("tfidf"))
        m = rows.join(sparse, "memory_id", "left").withColumn("v", F.coalesce("tfidf", F.lit(0.0)))
        words = T.keyword_score(F.lit(query), F.col("content"))
        score = (
            F.when(F.col("memory_type") == "working", S.working_score(F.col("v"), words, S.working_decay(F.col("ts"), as_of, self.ttl), F.col("importance")))
            .when(F.col("memory_type") == "episodic", S.episodic_score(F.col("v"), words, S.episodic_recency(F.col("ts"), as_of), F.col("importance")))
            .when(F.col("memory_type") == "perceptual", S.perceptual_score(F.col("v"), S.perceptual_recency(F.col("ts"), as_of), F.col("importance")))
            .otherwise(S.semantic_score(F.col("v"), words, F.col("importance")))
        )
        return m.select("memory_id", "content", "memory_type", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), "memory_id").limit(limit)

    def maintain(self, as_of: Column, strategy: str = "mixed", threshold: float = 0.3, max_age_days: float = 30, similarity: float | None = None) -> None:
        """The next snapshot: forgetting, then duplicates."""
        kept = memory.forget(self.rows, strategy, as_of, threshold, max_age_days)
        self.tables.replace("memories", kept if similarity is None else memory.drop_duplicates(kept, similarity))

    def consolidate(self, min_importance: float = 0.7) -> None:
        """Important working memories of a session become one episodic one; the others stay."""
        rows = self.rows
        merged = memory.consolidate(rows.where("memory_type = 'working'"), min_importance)
        new = merged.select(
            F.concat(F.lit("c-"), F.md5(F.array_join("source_ids", ","))).alias("memory_id"), "content", F.lit("episodic").alias("memory_type"), "importance",
            F.lit(None).cast("timestamp_ntz").alias("ts"), "session_id", F.lit("text").alias("modality"), F.lit(None).cast("string").alias("file_path"),
        )
        gone = (F.col("memory_type") == "working") & (F.col("importance") >= min_importance)
        self.tables.replace("memories", rows.where(~gone).unionByName(new))


def build_context(query: str, parts: dict[str, DataFrame], as_of: Column, budget: int, limit: int, threshold: float = 0.0, role: str = "", state: str = "", output: str = "") -> tuple[DataFrame, DataFrame]:
    """Gather, select, structure and compress as one plan: (context, statistics). parts: source to (content, ts); the source "system" always stays."""
    rows = context.gather(parts).withColumn("id", F.xxhash64("source", "content"))
    others = context.score_packets(rows.where("source <> 'system'"), F.lit(query), as_of, threshold=threshold).withColumn("q", F.lit(0))
    used = parts["system"].agg(F.coalesce(F.sum(T.token_estimate(F.col("content"))), F.lit(0))).first()[0] if "system" in parts else 0
    chosen = others.join(context.greedy_budget(others, max(0, budget - used), "q", "id"), ["q", "id"])
    ranked = chosen.select(F.lit(0).alias("q"), F.lit(query).alias("query"), "source", "content", (-F.col("score")).alias("position"))
    system = rows.where("source = 'system'").select(F.lit(0).alias("q"), F.lit(query).alias("query"), "source", "content", F.lit(-10.0).alias("position"))
    base = rows.sparkSession.createDataFrame([(0, query, None, None, 0.0)], "q int, query string, source string, content string, position double")
    text = context.structure(ranked.unionByName(system).unionByName(base), "q", role, state, output)
    return context.compress_all(text, limit), context.pool_statistics(chosen, budget)
