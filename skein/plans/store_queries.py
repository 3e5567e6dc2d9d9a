"""Queries over stored tables that change: versions, growing indexes, metadata, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import providers
from skein.operators.embedcache import EmbeddingCache
from skein.operators.engine import Memory
from skein.operators.facades import MemoryActions, SemanticStore
from skein.operators.segments import TextIndex
from skein.plans.memory_queries import _FOUND
from skein.plans.registry import query
from skein.plans.retrieval_queries import TOP, _TOKENS, questions
from skein.session import load, new_folder, spread
from skein.sources.jsonindex import MetadataIndex
from skein.sources.store import Store


@query("store_time_travel", """with v as (select 1 as version, * from orders where o_orderdate < timestamp '1996-01-01' union all select 2, * from orders union all select 3, * from orders where o_orderstatus <> 'F')
select version, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from v group by 1, 2""")  # fmt: skip
def store_time_travel(spark, sf_dir):
    """Orders in three commits (the old ones, the rest, without those that are filled), each version read after the last by a store that was opened anew."""
    orders, folder = load(spark, sf_dir, "orders"), new_folder(spark, "store")
    store = Store(spark, folder)
    store.append("orders", orders.where("o_orderdate < timestamp '1996-01-01'"))
    store.append("orders", orders.where("o_orderdate >= timestamp '1996-01-01' or o_orderdate is null"))
    with store.begin() as t:
        t.replace("orders", t.read("orders").where("o_orderstatus <> 'F'"))
    again = Store(spark, folder)
    rows = None
    for v in again.versions():
        one = again.read("orders", v).withColumn("version", F.lit(v))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("version", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_LIVE = _TOKENS.replace("from documents)", "from documents where lang <> 'fr')").replace("total as (select count(*) as total from documents where lang <> 'fr')", "total as (select count(*) as total from documents where lang <> 'fr')")


@query("text_index_grows", f"""with {_LIVE} f as (select count(*) as n, (select avg(coalesce(size, 0)) from documents left join size on id = doc_id where lang <> 'fr') as mean from documents where lang <> 'fr'),
i as (select term, ln(1 + (f.n - count(*) + 0.5) / (count(*) + 0.5)) as idf from p, f group by term, f.n),
s as (select query_id, tf.id as chunk_id, round(sum(idf * tf.n * 2.5 / (tf.n + 1.5 * (0.25 + 0.75 * size / mean))), 6) as score from tf join i using (term) join (select distinct query_id, term from qt) using (term), f group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s where score > 0)
select query_id, chunk_id, score, rank from ranked where rank <= {TOP}""")  # fmt: skip
def text_index_grows(spark, sf_dir):
    """An index that got the documents language by language, some twice, lost those in French again and was merged: its best rows for every question."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    index = TextIndex(Store(spark, new_folder(spark, "grows")))
    for lang in ("en", "fr", "de", "es"):
        index.add(docs.where(F.col("lang") == lang), "doc_id")
    index.add(docs.where("lang = 'de'"), "doc_id")
    index.delete(docs.where("lang = 'fr'").select(F.col("doc_id").alias("id")))
    index.merge(2)
    return index.bm25_top(questions(spark, sf_dir), TOP)


@query("metadata_index", """select event_id as id, 'contains' as filter from events where json_extract(props, '$.k') = 7 union all select event_id, 'range' from events where try_cast(json_extract_string(props, '$.k') as double) between 90 and 92
union all select event_id, 'key' from events where json_exists(props, '$.k')""")  # fmt: skip
def metadata_index(spark, sf_dir):
    """Events by what their props contain, by a range of a number in them and by a key, from an index over the JSON."""
    index = MetadataIndex.build(spread(load(spark, sf_dir, "events").select("event_id", "props")), "event_id", "props", new_folder(spark, "metadata"), 20_000)
    parts = {"contains": index.containing({"k": 7}), "range": index.between(("k",), 90, 92), "key": index.has_key("k")}
    out = None
    for name, ids in parts.items():
        one = ids.select("id", F.lit(name).alias("filter"))
        out = one if out is None else out.unionByName(one)
    return out


@query("embedding_cache", """with t as (select distinct coalesce(text, '') as text, lang from documents) select 'first' as run, count(distinct text) filter (where lang = 'en') as encoded, 0::bigint as failed from t
union all select 'second', count(distinct text) - count(distinct text) filter (where lang = 'en'), 0 from t union all select 'third', 0, 0""")  # fmt: skip
def embedding_cache(spark, sf_dir):
    """How many texts were encoded: those in English first, then those of all documents, then the same again by a cache that was opened anew."""
    docs, folder = load(spark, sf_dir, "documents").select("text", "lang"), new_folder(spark, "cache")
    rows = []
    for run, part in (("first", docs.where("lang = 'en'")), ("second", docs), ("third", docs)):
        rows.append((run, *EmbeddingCache(Store(spark, folder), "hashed-64", providers.hashing_encoder()).fill(part)))
    return spark.createDataFrame(rows, "run string, encoded long, failed long")


@query("semantic_insert", f"with {_FOUND.replace('from documents)', 'from (select item_id as doc_id, text from benchmark))')} select a.memory_id, a.key as source, b.key as target, 0.5::double as weight from f a join f b on a.memory_id = b.memory_id and a.key < b.key")
def semantic_insert(spark, sf_dir):
    """The edges of a semantic store that took the benchmark's items in two commits, the second with all of them: known ones are left as they are."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("memory_id"), F.col("text").alias("content"))
    folder = new_folder(spark, "semantic")
    SemanticStore(Store(spark, folder), providers.hashing_encoder(16)).insert(items.where(F.length("content") > 60))
    again = SemanticStore(Store(spark, folder), providers.hashing_encoder(16))
    again.insert(items)
    return again.tables.read("edges").select("memory_id", "source", "target", "weight")


@query("replace_all_memories", """select memory_type, count(*) as n, round(avg(importance), 6) as importance from (select case when turn = 0 then 'semantic' else 'episodic' end as memory_type, case when turn = 0 then 0.9::double else 0.25::double end as importance from conversations) group by 1""")
def replace_all_memories(spark, sf_dir):
    """Turns of conversations as memories of two types, the episodic ones replaced as a whole; a store that is opened anew has the new rows alone."""
    turns = load(spark, sf_dir, "conversations")
    row = lambda kind, weight: turns.where(F.col("turn") == 0 if kind == "semantic" else F.col("turn") != 0).select(
        F.concat_ws("-", "conv_id", "turn").alias("memory_id"), F.col("text").alias("content"), F.lit(kind).alias("memory_type"), F.lit(weight).alias("importance"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.col("conv_id").cast("string").alias("session_id"), F.lit("text").alias("modality"), F.lit(None).cast("string").alias("file_path"),
    )
    folder = new_folder(spark, "memories")
    store = Memory(spark, folder)
    store.add(row("semantic", 0.9))
    store.add(row("episodic", 0.5))
    MemoryActions(store, F.lit("2024-01-02").cast("timestamp_ntz")).replace_all(row("episodic", 0.25), "episodic")
    return Memory(spark, folder).rows.groupBy("memory_type").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("importance"))
