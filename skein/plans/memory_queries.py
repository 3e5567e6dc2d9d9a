"""Memory, graph, context and routing queries over events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import scores as S
from skein.functions import text as T
from skein.functions.lexicons import TECH_ENTITIES, TECH_WORDS
from skein.operators import context as C
from skein.operators import graph as G
from skein.operators import logs as L
from skein.operators import memory as M
from skein.operators import routing as R
from skein.plans.registry import query
from skein.session import load, new_folder, spread

AS_OF_TEXT = "2024-01-31 00:00:00"
DUCK_AS_OF = f"timestamp '{AS_OF_TEXT}'"

# Events as memories: importance from the id, the type from the event's, the session is the user.
_MEM = """m as (select event_id as memory_id, event_type || ' ' || props as content, case event_id % 4 when 0 then 'working' when 1 then 'episodic' when 2 then 'semantic' else 'perceptual' end as memory_type,
 (event_id % 11) / 10.0::double as importance, ts, cast(user_id as varchar) as session_id, case when event_id % 5 = 0 then 'image' when event_id % 7 = 0 then null else 'text' end as modality, value from events)"""


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "working").when(F.col("event_id") % 4 == 1, "episodic").when(F.col("event_id") % 4 == 2, "semantic").otherwise("perceptual")
    modality = F.when(F.col("event_id") % 5 == 0, "image").when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise("text")
    return e.select(F.col("event_id").alias("memory_id"), F.concat_ws(" ", "event_type", "props").alias("content"), kind.alias("memory_type"), ((F.col("event_id") % 11) / 10.0).alias("importance"), "ts", F.col("user_id").cast("string").alias("session_id"), modality.alias("modality"), "value")


_SECONDS = f"(epoch_us({DUCK_AS_OF}) - epoch_us(ts)) / 1e6::double"
_WEIGHT = "(0.8::double + importance * 0.4::double)"


def _scored(df: DataFrame, score: Column) -> DataFrame:
    return df.select("memory_id", F.round(score, 6).alias("score"))


def _keyword(q: str) -> Column:
    return T.keyword_score(F.lit(q), F.col("content"))


_KEYWORD = """(case when len(regexp_extract_all(lower(content), '[a-z0-9]+')) = 0 then 0::double else least(1::double,
 len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')), {q}))::double / len(list_distinct(list_concat(regexp_extract_all(lower(content), '[a-z0-9]+'), {q}))) + case when contains(lower(content), '{s}') then 0.15::double else 0 end) end)"""
_PURCHASE = _KEYWORD.format(q="['purchase', 'k']", s="purchase k")


@query("working_score", f"with {_MEM} select memory_id, round({_PURCHASE} * exp(-({_SECONDS} / 60) / 43200) * {_WEIGHT}, 6) as score from m")
def working_score(spark, sf_dir):
    decay = S.working_decay(F.col("ts"), as_of(), 43200)
    return _scored(memories(spark, sf_dir), S.working_score(F.lit(0.0), _keyword("purchase k"), decay, F.col("importance")))


@query("episodic_score", f"with {_MEM} select memory_id, round(({_PURCHASE} * 0.8::double + exp(-({_SECONDS} / 86400) / 30) * 0.2::double) * {_WEIGHT}, 6) as score from m")
def episodic_score(spark, sf_dir):
    return _scored(memories(spark, sf_dir), S.episodic_score(F.lit(0.0), _keyword("purchase k"), S.episodic_recency(F.col("ts"), as_of()), F.col("importance")))


@query("semantic_score", f"with {_MEM} select memory_id, round((value / 1000 * 0.7::double + importance * 0.3::double) * {_WEIGHT}, 6) as score from m")
def semantic_score(spark, sf_dir):
    return _scored(memories(spark, sf_dir), S.semantic_score(F.col("value") / 1000, F.col("importance"), F.col("importance")))


@query("perceptual_score", f"with {_MEM} select memory_id, round((greatest(0.1::double, exp(-0.1::double * ({_SECONDS} / 3600) / 24)) * 0.2::double) * {_WEIGHT}, 6) as score from m where coalesce(modality, 'text') = 'image' and importance >= 0.3::double")
def perceptual_score(spark, sf_dir):
    return _scored(M.of_modality(memories(spark, sf_dir), "image", 0.3), S.perceptual_score(F.lit(0.0), S.perceptual_recency(F.col("ts"), as_of()), F.col("importance")))


@query("context_recency", f"with {_MEM} select memory_id, round(case when {_SECONDS} / 3600 <= 24 then 1::double else exp(-({_SECONDS} / 3600 - 24) / 72) end, 6) as score from m")
def context_recency(spark, sf_dir):
    return _scored(memories(spark, sf_dir), S.context_recency(F.col("ts"), as_of()))


@query("note_boost", "select event_id, round(least(1.0::double, greatest(0.0::double, (event_id % 100) / 100.0::double + case event_type when 'error' then 0.25::double when 'purchase' then 0.15::double else 0 end)), 6) as score from events")
def note_boost(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "blocker").when(F.col("event_type") == "purchase", "action").otherwise("general")
    return load(spark, sf_dir, "events").select("event_id", F.round(S.note_score((F.col("event_id") % 100) / 100.0, kind), 6).alias("score"))


_TECH = " + ".join(f"contains(both_, '{w.lower()}')::int" for w in TECH_WORDS)
_PAIRS = "p as (select q.conv_id, q.turn, q.text as question, a.text as answer from conversations q join conversations a on q.conv_id = a.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant')"


@query("adaptive_importance", f"""with {_PAIRS}, t as (select *, lower(question || ' ' || answer) as both_ from p), s as (select *, {_TECH} as tech from t)
select conv_id, turn, round(least(1.0::double, greatest(0.5::double, 0.5::double + least(2 * (
 case when length(question) >= 30 then 0.2::double when length(question) >= 10 then 0.1::double else 0 end * 0.25::double
 + case when length(answer) >= 200 then 0.2::double when length(answer) >= 50 then 0.1::double else 0 end * 0.25::double
 + case when tech >= 5 then 0.3::double when tech >= 3 then 0.2::double when tech >= 1 then 0.1::double else 0 end * 0.30::double
 + case when turn >= 3 then 0.2::double when turn >= 1 then 0.1::double else 0 end * 0.20::double), 0.5::double))), 2) as importance from s""")  # fmt: skip
def adaptive_importance(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", S.adaptive_importance(F.col("question"), F.col("answer"), F.col("turn"), TECH_WORDS).alias("importance"))


@query("episodic_prefilter", f"with {_MEM} select memory_id, importance from m where ts between timestamp '2024-01-05' and timestamp '2024-01-12' and importance >= 0.5::double and session_id = '3'")
def episodic_prefilter(spark, sf_dir):
    day = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    return M.prefilter(memories(spark, sf_dir), day("2024-01-05"), day("2024-01-12"), "3", 0.5).select("memory_id", "importance")


_OLD = f"ts < {DUCK_AS_OF} - interval 20 day"


@query("forget_importance", f"with {_MEM} select memory_id from m where not (importance < 0.3::double)")
def forget_importance(spark, sf_dir):
    return M.forget(memories(spark, sf_dir), "importance", threshold=0.3).select("memory_id")


@query("forget_time", f"with {_MEM} select memory_id from m where not ({_OLD})")
def forget_time(spark, sf_dir):
    return M.forget(memories(spark, sf_dir), "time", as_of(), max_age_days=20).select("memory_id")


@query("forget_mixed", f"with {_MEM} select memory_id from m where not ({_OLD} and importance < 0.3::double)")
def forget_mixed(spark, sf_dir):
    return M.forget(memories(spark, sf_dir), "mixed", as_of(), 0.3, 20).select("memory_id")


@query("forget_capacity", f"with {_MEM} select memory_id from m order by importance desc, ts desc, memory_id desc limit 500")
def forget_capacity(spark, sf_dir):
    return M.forget(memories(spark, sf_dir), "capacity", capacity=500).select("memory_id")


_SETS = """s as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents),
c as (select doc_id, t, min(doc_id) over (partition by md5(array_to_string(list_sort(t), ' '))) as rep from s where len(t) > 0),
p as (select a.doc_id as a, b.doc_id as b, len(list_intersect(a.t, b.t))::double / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) as similarity from c a join c b
    on a.doc_id < b.doc_id and a.doc_id = a.rep and b.doc_id = b.rep and least(len(a.t), len(b.t)) >= 0.8 * greatest(len(a.t), len(b.t)))"""


def _texts(spark, sf_dir) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"), ((F.col("doc_id") % 7) / 10.0).alias("importance")))


@query("dedup_pairs", f"with {_SETS} select rep as a, doc_id as b, 1.0::double as similarity, 'member' as kind from c where doc_id <> rep union all select a, b, round(similarity, 6), 'pair' from p where similarity >= 0.8")
def dedup_pairs(spark, sf_dir):
    """Copies are told by membership (member: b has the tokens of a), pairs are those of representatives."""
    sets = M.token_sets(_texts(spark, sf_dir))
    classes = M.token_classes(sets)
    members = classes.where("memory_id <> rep").select(F.col("rep").alias("a"), F.col("memory_id").alias("b"), F.lit(1.0).alias("similarity"), F.lit("member").alias("kind"))
    return members.unionByName(M.class_pairs(sets, classes, 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"), F.lit("pair").alias("kind")))


@query("dedup_jaccard", f"""with {_SETS}, e as (select a, b from p where similarity >= 0.8 union all select b, a from p where similarity >= 0.8 union all select distinct rep, rep from c),
l as (select x.doc_id from e join c x on x.rep = e.a join c y on y.rep = e.b where y.doc_id % 7 > x.doc_id % 7 or (y.doc_id % 7 = x.doc_id % 7 and y.doc_id < x.doc_id))
select doc_id as memory_id from documents where doc_id not in (select doc_id from l)""")
def dedup_jaccard(spark, sf_dir):
    return M.drop_class_duplicates(_texts(spark, sf_dir), 0.8).select("memory_id")


@query("consolidate", f"with {_MEM} select session_id, string_agg(content, chr(10) order by ts, memory_id) as content, round(least(1.0::double, avg(importance) + 0.1::double), 6) as importance, count(*) as merged from m where importance >= 0.7::double group by 1")
def consolidate(spark, sf_dir):
    return M.consolidate(memories(spark, sf_dir), 0.7).select("session_id", "content", F.round("importance", 6).alias("importance"), "merged")


@query("consolidate_media", f"with {_MEM} select memory_id, memory_id as source_id, 'semantic' as memory_type from m where coalesce(modality, 'text') <> 'text' and memory_id % 3 <> 0")
def consolidate_media(spark, sf_dir):
    m = memories(spark, sf_dir)
    done = m.where("memory_id % 3 = 0").select(F.col("memory_id").alias("source_id"))
    return M.copy_with_provenance(m, done).select("memory_id", "source_id", "memory_type")


@query("rebuild_antijoin", f"with {_MEM} select memory_id from m where importance >= 0.8::double and memory_id % 2 = 1")
def rebuild_antijoin(spark, sf_dir):
    m = memories(spark, sf_dir)
    return M.rebuild(m, m.where("memory_id % 2 = 0").select("memory_id")).select("memory_id")


@query("time_window_report", f"with {_MEM} select memory_type, count(*) as n, round(avg(importance), 6) as mean_importance from m where ts >= {DUCK_AS_OF} - interval 10080 minute group by 1")
def time_window_report(spark, sf_dir):
    return M.window_report(memories(spark, sf_dir), as_of(), 10080).withColumn("mean_importance", F.round("mean_importance", 6))


@query("upsert_latest", "with b as (select c_custkey, c_acctbal, 1 as version, 0 as fresh from customer union all select c_custkey, c_acctbal + 100, 2, 1 from customer where c_custkey % 3 = 0), r as (select *, row_number() over (partition by c_custkey order by version desc, fresh desc) as r from b) select c_custkey, round(c_acctbal, 4) as c_acctbal, version from r where r = 1")
def upsert_latest(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("version"))
    changes = c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 100).alias("c_acctbal"), F.lit(2).alias("version"))
    return M.upsert(c, changes, "c_custkey", "version").withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("delete_by_key", "select o_orderkey, o_totalprice from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def delete_by_key(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return M.remove(o, o.where("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("store_merge", f"with {_MEM}, a as (select memory_id, round(importance, 6) as score, 'working' as store from m where memory_type = 'working' union all select memory_id, round(importance * 0.9::double, 6), 'episodic' from m where memory_type = 'episodic') select memory_id, score, store from a order by score desc, store, memory_id limit 25")
def store_merge(spark, sf_dir):
    m = memories(spark, sf_dir)
    part = lambda kind, f: m.where(F.col("memory_type") == kind).select("memory_id", F.round(F.col("importance") * f, 6).alias("score"))
    return M.merge_stores({"working": part("working", 1.0), "episodic": part("episodic", 0.9)}, 25)


@query("store_counts", f"with {_MEM} select memory_type, count(*) as n from m group by 1 union all select 'all', count(*) from m")
def store_counts(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.rollup("memory_type").agg(F.count("*").alias("n")).select(F.coalesce("memory_type", F.lit("all")).alias("memory_type"), "n")


# Knowledge graph: the entities of every document. The documents hold no CJK text, so the SQL leaves out the patterns for it.
_FOUND = rf"""n as (select doc_id as memory_id, unnest(list_concat(list_filter({sorted(TECH_ENTITIES)!r}, lambda w: contains(lower(text), w)), list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda p: regexp_full_match(p, '[A-Z][a-zA-Z]{{2,}}')),
    list_filter(regexp_extract_all(text, '[「"'']([^\n\r]+?)[」"'']', 1), lambda q: length(q) >= 2))) as name from documents), f as (select distinct memory_id, lower(name) as key from n)"""


def mentioned(spark, sf_dir) -> DataFrame:
    return G.mentions(spread(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))))


@query("entities", f"with {_FOUND} select key, count(*) as memories from f group by 1")
def entities(spark, sf_dir):
    return G.entities(mentioned(spark, sf_dir)).select("key", "memories")


@query("entity_memory_ids", f"with {_FOUND} select key, string_agg(memory_id, ',' order by memory_id) as ids from f group by 1")
def entity_memory_ids(spark, sf_dir):
    return G.memory_ids(mentioned(spark, sf_dir)).select("key", F.array_join(F.transform("memory_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("cooccurrence_edges", f"with {_FOUND} select a.key as source, b.key as target, count(*) as n, round(count(*) * 0.5, 2)::double as weight from f a join f b on a.memory_id = b.memory_id and a.key < b.key group by 1, 2 having count(*) > 1")
def cooccurrence_edges(spark, sf_dir):
    return G.edge_counts(mentioned(spark, sf_dir), new_folder(spark, "mentions")).withColumn("weight", F.round("weight", 2))


@query("entity_relations", f"with {_FOUND} select a.memory_id, a.key as source, b.key as target from f a join f b on a.memory_id = b.memory_id and a.key < b.key where a.key = 'the' or b.key = 'the'")
def entity_relations(spark, sf_dir):
    asked = spark.createDataFrame([("the",)], "key string")
    return G.relations_of(G.edges_at(mentioned(spark, sf_dir), asked), "The").select("memory_id", "source", "target")


@query("graph_score", f"""with {_FOUND}, q as (select unnest(['the', 'and', 'with']) as key), e as (select a.memory_id as origin, a.key as source, b.key as target from f a join f b on a.memory_id = b.memory_id and a.key < b.key where a.key in (select key from q) or b.key in (select key from q)),
l as (select e.*, f.memory_id from e join f on e.target = f.key where e.source in (select key from q) union select e.*, f.memory_id from e join f on e.source = f.key where e.target in (select key from q)),
s as (select memory_id, sum(0.5::double * case when origin = memory_id then 0.3::double else 0.15::double end) as links from l group by 1),
o as (select memory_id, count(*) as size, count(q.key) as shared from f left join q on f.key = q.key group by 1)
select o.memory_id, round(least(1.0::double, shared::double / (size + 3 - shared) * 0.6::double + coalesce(links, 0) * 0.4::double), 6) as score from o left join s using (memory_id) where shared > 0 or links is not null""")  # fmt: skip
def graph_score(spark, sf_dir):
    path = new_folder(spark, "mentions")
    mentioned(spark, sf_dir).write.parquet(path)  # read in ten places of the plan
    f = G.dealt(spark.read.parquet(path))
    q = spark.createDataFrame([("the",), ("and",), ("with",)], "key string")
    return G.graph_scores(q, f, G.edges_at(f, q)).withColumn("score", F.round("score", 6))


# Context assembly: turns of a conversation as packets.
def packets(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("content"), T.token_estimate(F.col("text")).cast("long").alias("tokens"), F.round(F.length("text") % 17 / 17.0, 6).alias("score"))


_PACKETS = r"k as (select conv_id, turn, text as content, len(regexp_extract_all(text, '\S+')) as tokens, round(length(text) % 17 / 17.0::double, 6) as score from conversations)"


@query("minmax_recency", "select event_id, round(case when max(ts) over w = min(ts) over w then 1::double else (epoch_us(ts) - epoch_us(min(ts) over w))::double / (epoch_us(max(ts) over w) - epoch_us(min(ts) over w)) end, 6) as recency from events window w as (partition by user_id)")
def minmax_recency(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(C.minmax_recency(None, "user_id"), 6).alias("recency"))


@query("prefix_budget", f"with {_PACKETS}, s as (select *, sum(tokens) over (partition by conv_id order by score desc, turn) as used from k) select conv_id, turn, used from s where used <= 120")
def prefix_budget(spark, sf_dir):
    return C.prefix_budget(packets(spark, sf_dir), 120, "conv_id", [F.col("score").desc(), F.col("turn")]).select("conv_id", "turn", "used")


@query("greedy_budget", f"""with recursive {_PACKETS}, o as (select conv_id, turn, tokens, row_number() over (partition by conv_id order by score desc, turn) as r from k),
g as (select conv_id, turn, r, case when tokens <= 120 then tokens else 0 end as used, tokens <= 120 as taken from o where r = 1
 union all select o.conv_id, o.turn, o.r, case when g.used + o.tokens <= 120 then g.used + o.tokens else g.used end, g.used + o.tokens <= 120 from g join o on o.conv_id = g.conv_id and o.r = g.r + 1)
select conv_id, turn from g where taken""")  # fmt: skip
def greedy_budget(spark, sf_dir):
    return C.greedy_budget(packets(spark, sf_dir), 120, "conv_id", "turn")


@query("gather_union", "select 'rag' as source, count(*) as n from documents union all select 'memory', count(*) from events union all select 'history', count(*) from conversations")
def gather_union(spark, sf_dir):
    none = F.lit(None).cast("timestamp_ntz").alias("ts")
    parts = {
        "rag": load(spark, sf_dir, "documents").select(F.col("text").alias("content"), none),
        "memory": load(spark, sf_dir, "events").select(F.col("props").alias("content"), "ts"),
        "history": load(spark, sf_dir, "conversations").select(F.col("text").alias("content"), none),
    }
    return C.gather(parts).groupBy("source").agg(F.count("*").alias("n"))


@query("structure_render", """with c as (select conv_id, turn, role, text from conversations), t as (select conv_id, min(text) filter (turn = 0) as query,
 string_agg(text, chr(10) order by turn) filter (role = 'system') as sys, string_agg('[' || rn || '] ' || text, chr(10) order by turn) filter (role = 'assistant') as ev, string_agg('- ' || text, chr(10) order by turn) filter (role = 'user') as ctx
 from (select *, row_number() over (partition by conv_id, role order by turn) as rn from c) group by 1)
select conv_id, '[Role & Policies]' || chr(10) || coalesce(sys, 'role') || chr(10) || chr(10) || '[Task]' || chr(10) || coalesce(query, '') || chr(10) || chr(10) || '[State]' || chr(10) || 'state' || chr(10) || chr(10)
 || '[Evidence]' || chr(10) || coalesce(ev, '（无检索证据）') || chr(10) || chr(10) || '[Context]' || chr(10) || coalesce(ctx, '（无历史上下文）') || chr(10) || chr(10) || '[Output]' || chr(10) || 'out' as text from t""")  # fmt: skip
def structure_render(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("query"))
    source = F.when(F.col("role") == "system", "system").when(F.col("role") == "assistant", "rag").otherwise("history")
    rows = c.join(first, "conv_id").select("conv_id", "query", source.alias("source"), F.col("text").alias("content"), F.col("turn").alias("position"))
    return C.structure(rows, "conv_id", "role", "state", "out")


@query("compress_context")
def compress_context(spark, sf_dir):
    rows = structure_render(spark, sf_dir)
    return C.compress_all(rows, 150).select("conv_id", "was_compressed", "tokens", F.length("compressed").alias("chars"))


@query("packet_fingerprint", "select conv_id, turn, substr(md5(concat_ws('|', cast(conv_id as varchar), cast(turn as varchar), role, text)), 1, 16) as fingerprint from conversations")
def packet_fingerprint(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.fingerprint(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role"), F.col("text")).alias("fingerprint"))


@query("pool_statistics", f"with {_PACKETS} select count(*) as packets, sum(tokens)::bigint as tokens, round(avg(score), 6) as score, round(sum(tokens) / 1000000.0::double, 6) as utilisation from k")
def pool_statistics(spark, sf_dir):
    rows = packets(spark, sf_dir).withColumn("source", F.lit("history")).withColumn("relevance", F.lit(0.0)).withColumn("recency", F.lit(1.0))
    return C.pool_statistics(rows, 1_000_000).select("packets", "tokens", F.round("score", 6).alias("score"), F.round("utilisation", 6).alias("utilisation"))


# Logs.
@query("session_last_n", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 3")
def session_last_n(spark, sf_dir):
    return L.last_n(load(spark, sf_dir, "conversations"), 3, "conv_id", "turn").select("conv_id", "turn", "role")


@query("session_last_n_by_role", "select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations where role = 'user') where r <= 2")
def session_last_n_by_role(spark, sf_dir):
    return L.last_n(load(spark, sf_dir, "conversations").where("role = 'user'"), 2, "conv_id", "turn").select("conv_id", "turn")


@query("session_trim", "with r as (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) select conv_id, count(*) as kept from r where r <= 4 group by 1")
def session_trim(spark, sf_dir):
    return L.last_n(load(spark, sf_dir, "conversations"), 4, "conv_id", "turn").groupBy("conv_id").agg(F.count("*").alias("kept"))


@query("session_counts", "select c_custkey, count(o_orderkey) as messages from customer left join orders on c_custkey = o_custkey group by 1")
def session_counts(spark, sf_dir):
    return L.session_counts(load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("append_known_sessions", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def append_known_sessions(spark, sf_dir):
    known = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return L.append_known(load(spark, sf_dir, "orders"), known, "o_custkey").select("o_orderkey")


@query("dialogue_depth", "select conv_id, turn, sum((role = 'user')::int) over (partition by conv_id order by turn rows between 5 preceding and current row)::bigint as depth from conversations")
def dialogue_depth(spark, sf_dir):
    return L.dialogue_depth(load(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "depth")


@query("trace_aggregate", "select user_id, count(*) as calls, count(*) filter (event_type = 'error') as failures, round(avg(case when event_type = 'error' then 0.0::double else 1.0::double end), 6) as success_rate, round(avg(value), 6) as mean_duration from events group by 1")
def trace_aggregate(spark, sf_dir):
    out = L.trace_summary(load(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", "value")
    return out.withColumn("success_rate", F.round("success_rate", 6)).withColumn("mean_duration", F.round("mean_duration", 6))


@query("failure_runs", """with i as (select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) as island from events)
select event_id, sum((event_type = 'error')::int) over (partition by user_id, island order by ts, event_id)::bigint as run from i""")  # fmt: skip
def failure_runs(spark, sf_dir):
    return L.failure_runs(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "run")


@query("throttled_tools", """with i as (select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) as island from events), r as (select *, sum((event_type = 'error')::int) over (partition by user_id, island order by ts, event_id) as run from i)
select user_id, min(ts) as disabled_at, max(run)::bigint as longest from r where run >= 2 group by 1""")  # fmt: skip
def throttled_tools(spark, sf_dir):
    runs = L.failure_runs(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return runs.where("run >= 2").groupBy("user_id").agg(F.min("ts").alias("disabled_at"), F.max("run").alias("longest"))


@query("recent_failures", "select event_id, user_id, ts from events where event_type = 'error' order by ts desc, event_id desc limit 5")
def recent_failures(spark, sf_dir):
    return L.recent_failures(load(spark, sf_dir, "events"), F.col("event_type") == "error", [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id", "ts")


@query("ring_buffer", "select event_id from (select event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 20")
def ring_buffer(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("order_", F.struct("ts", "event_id"))
    return L.last_n(e, 20, "user_id", "order_").select("event_id")


@query("failure_chain", "select user_id, string_agg(event_id, ',' order by ts, event_id) as chain from events where event_type = 'error' group by 1")
def failure_chain(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("success"))
    traces = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "status"))).alias("events"))
    chain = F.array_join(F.transform(L.failure_chain(F.col("events")), lambda x: x["event_id"].cast("string")), ",")
    return traces.select("user_id", chain.alias("chain")).where("chain <> ''")


@query("monitor_aggregate", """with s as (select source, sum(n_chars)::bigint as v from documents group by 1) select (select count(*) from documents) as entries, (select round(avg(n_chars), 4) from documents) as mean_tokens, (select round(avg((lang = 'en')::int), 6) from documents) as cache_hit_rate,
 (select string_agg(source || '=' || v, ';' order by source) from s) as sources""")  # fmt: skip
def monitor_aggregate(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    rows = d.select(F.col("n_chars").alias("tokens"), (F.col("lang") == "en").alias("cache_hit"), F.lit(False).alias("compressed"), F.create_map("source", "n_chars").alias("sources"))
    out = L.monitor_summary(rows)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.select("entries", F.round("mean_tokens", 4).alias("mean_tokens"), F.round("cache_hit_rate", 6).alias("cache_hit_rate"), text.alias("sources"))


@query("cadence_triggers", "with n as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations) select conv_id, turn, n % 2 = 0 as shallow, n % 4 = 0 as deep from n")
def cadence_triggers(spark, sf_dir):
    return L.every_nth(load(spark, sf_dir, "conversations"), "conv_id", ["turn"], {"shallow": 2, "deep": 4}).select("conv_id", "turn", "shallow", "deep")


@query("hot_query_cache", "select event_id, row_number() over (partition by props order by ts, event_id) >= 2 as hot from events")
def hot_query_cache(spark, sf_dir):
    return L.hot_from_second(load(spark, sf_dir, "events"), "props", ["ts", "event_id"]).select("event_id", "hot")


@query("latest_per_type", "select event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def latest_per_type(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# Routing.
@query("query_route_fast_full", r"""select conv_id, turn, case when lower(trim(text)) in ('hi', 'hello', 'hey') then 'fast' when length(trim(text)) < 8 then 'fast' when length(trim(text)) > 30 then 'full' else 'fast' end as channel from conversations where role = 'user'""")
def query_route_fast_full(spark, sf_dir):
    return load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", R.channel(F.col("text")).alias("channel"))


@query("feature_vector", r"""select conv_id, turn, least(5, 1 + (length(trim(text)) > 30)::int + (length(trim(text)) > 80)::int + (len(regexp_extract_all(text, '\?')) >= 2)::int) as complexity from conversations where role = 'user'""")
def feature_vector(spark, sf_dir):
    return load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", R.features(F.col("text"))["complexity"].alias("complexity"))


@query("paradigm_route", r"""with f as (select conv_id, turn, least(5, 1 + (length(trim(text)) > 30)::int + (length(trim(text)) > 80)::int + (len(regexp_extract_all(text, '\?')) >= 2)::int) as c from conversations where role = 'user')
select conv_id, turn, case when c = 1 then 'simple' else 'tree_of_thought' end as paradigm, round(1.0::double, 6) as "match" from f where c <= 3""")  # fmt: skip
def paradigm_route(spark, sf_dir):
    out = R.route(load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query")))
    return out.where("features.complexity <= 3").select("conv_id", "turn", "paradigm", F.round("match", 6).alias("match"))


@query("routing_accuracy", r"""with f as (select length(trim(text)) <= 30 as short from conversations where role = 'user'), g as (select case when short then 'simple' else 'tree_of_thought' end as expected from f)
select coalesce(expected, 'all') as expected, count(*) as n, round(1.0::double, 6) as accuracy from g group by rollup (expected)""")  # fmt: skip
def routing_accuracy(spark, sf_dir):
    q = load(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("text").alias("query"), F.when(F.length(F.trim("text")) <= 30, "simple").otherwise("tree_of_thought").alias("expected"))
    return R.accuracy(R.route(q)).select(F.coalesce("expected", F.lit("all")).alias("expected"), "n", F.round("accuracy", 6).alias("accuracy"))


@query("beam_search", "select depth, node_id, score from (select event_id as node_id, user_id % 5 as depth, round(value, 6) as score, row_number() over (partition by user_id % 5 order by round(value, 6) desc, event_id) as r from events where round(value, 6) >= 10) where r <= 3")
def beam_search(spark, sf_dir):
    nodes = load(spark, sf_dir, "events").select(F.col("event_id").alias("node_id"), (F.col("user_id") % 5).alias("depth"), F.round("value", 6).alias("score"))
    return R.beam(nodes, 3, 10).select("depth", "node_id", "score")


@query("session_listing", "select user_id as session, max(ts) as updated_at, min(ts) as created_at, count(*) as messages from events where event_type <> 'error' group by 1 order by updated_at desc, session limit 50")
def session_listing(spark, sf_dir):
    from skein.operators.facades import sessions

    return sessions(load(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") != "error")


def _operations(spark, sf_dir):
    """Purchases write a user's value, views read it."""
    e = load(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.when(F.col("event_type") == "view", "get").otherwise("set").alias("op"), F.col("event_id").cast("string").alias("value"))


@query("cache_replay", """with o as (select user_id, event_id, epoch_us(ts) / 1e6 as t, event_type = 'purchase' as is_set from events where event_type in ('purchase', 'view')),
l as (select *, max(case when is_set then t end) over w as written, last_value(case when is_set then event_id end ignore nulls) over w as value from o window w as (partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding))
select user_id::varchar as key, event_id as seq, coalesce(t < written + 86400, false) as hit, case when t < written + 86400 then value::varchar end as found from l where not is_set""")  # fmt: skip
def cache_replay(spark, sf_dir):
    from skein.streaming.state import cache_replay

    return cache_replay(_operations(spark, sf_dir), 86400.0).select("key", "seq", "hit", "found")


@query("tool_recovery")
def tool_recovery(spark, sf_dir):
    """Which calls a switched-off tool refuses: users as tools, error events as failures. A state machine has no SQL form."""
    from skein.streaming.state import disabled_calls

    e = load(spark, sf_dir, "events")
    result = F.when(F.col("event_type") == "error", "错误：x").when((F.col("event_type") == "signup") & (F.col("value") > 90), "【搜索不可用】").otherwise("ok")
    return disabled_calls(e.select(F.col("user_id").cast("string").alias("tool"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), result.alias("result")), 2, 86400.0)
