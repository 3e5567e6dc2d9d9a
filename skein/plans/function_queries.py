"""Scalar functions over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scores as S
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import providers as P
from skein.operators import retrieval as R
from skein.operators import traces as X
from skein.plans.registry import query
from skein.session import load


@query("keyword_topk", "select term, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) group by 1 order by n desc, term limit 50")
def keyword_topk(spark, sf_dir):
    found = R.terms(load(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.sum("n").alias("n"))
    return found.orderBy(F.col("n").desc(), "term").limit(50)


@query("data_uri", "select doc_id, md5('data:text/plain;base64,' || to_base64(encode(text))) as digest from documents")
def data_uri(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace(T.data_uri(F.col("text").cast("binary"), F.lit("text/plain")), r"\r?\n", "")).alias("digest"))


@query("age_of_events", "select event_id, round((epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 1000000.0::double / 60, 6) as minutes, round((epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 1000000.0::double / 86400, 6) as days from events")
def age_of_events(spark, sf_dir):
    seconds = S.age_seconds(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return load(spark, sf_dir, "events").select("event_id", F.round(seconds / 60, 6).alias("minutes"), F.round(seconds / 86400, 6).alias("days"))


@query("time_parts", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as time, dayname(ts) as weekday from events")
def time_parts(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", P.now_parts(F.col("ts").cast("timestamp")).alias("p")).select("event_id", "p.time", "p.weekday")


@query("iso_parse", "select event_id, try_cast(case when event_id % 3 = 0 then 'no time' else strftime(ts, '%Y-%m-%dT%H:%M:%S') end as timestamp) as parsed from events")
def iso_parse(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return load(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(raw).cast("timestamp_ntz").alias("parsed"))


@query("vector_text_codec", "select vec_id, round(list_sum(embedding::double[]), 6) as total, len(embedding) as n from embeddings")
def vector_text_codec(spark, sf_dir):
    text = V.to_text(F.col("embedding").cast("array<double>"))
    back = load(spark, sf_dir, "embeddings").select("vec_id", V.from_text(text).alias("v"))
    return back.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("v").cast("long").alias("n"))


@query("metadata_merge", "select o_orderkey, case when o_orderstatus = 'F' then o_orderpriority else 'kept' end as priority, o_orderstatus as status from orders")
def metadata_merge(spark, sf_dir):
    first = F.create_map(F.lit("priority"), F.when(F.col("o_orderstatus") != "F", F.lit("kept")))
    then = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    merged = load(spark, sf_dir, "orders").select("o_orderkey", P.merge_metadata(first, then).alias("m"))
    return merged.select("o_orderkey", F.col("m")["priority"].alias("priority"), F.col("m")["status"].alias("status"))


@query("json_round_trip", "select event_id, event_type, value from events")
def json_round_trip(spark, sf_dir):
    packed = load(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("j"))
    return packed.select(F.from_json("j", "event_id long, event_type string, value double").alias("r")).select("r.*")


@query("file_keywords", "select page_id, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '\\.[^.]*$', ''), '[-_.\\s]+'), lambda x: length(x) >= 2)[1:8], ' ') as words from pages")
def file_keywords(spark, sf_dir):
    name = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(T.file_keywords(name), " ").alias("words"))


@query("list_items", "select n_nationkey, n_name as item from nation")
def list_items(spark, sf_dir):
    mark = F.when(F.col("n_nationkey") % 3 == 0, "- ").when(F.col("n_nationkey") % 3 == 1, F.concat(F.col("n_nationkey").cast("string"), F.lit(". "))).otherwise("")
    return load(spark, sf_dir, "nation").select("n_nationkey", T.list_item(F.concat(mark, "n_name")).alias("item"))


@query("tool_calls", "select event_id, event_type as name, cast(user_id as varchar) as input from events")
def tool_calls(spark, sf_dir):
    text = F.concat(F.lit("I call [TOOL_CALL:"), "event_type", F.lit(": "), F.col("user_id").cast("string"), F.lit("] now"))
    return load(spark, sf_dir, "events").select("event_id", F.inline(T.tool_calls(text)))


@query("thought_action", "select event_id, 'step ' || event_type as thought, event_type as action, props as input from events where props not like '%]%'")
def thought_action(spark, sf_dir):
    text = F.concat(F.lit("Thought: step "), "event_type", F.lit("\nAction: "), "event_type", F.lit("["), "props", F.lit("]"))
    rows = load(spark, sf_dir, "events").where("props not like '%]%'").select("event_id", X.thought_and_action(text).alias("x"))
    return rows.select("event_id", "x.thought", "x.action", "x.input")


@query("finish_answers", "select event_id, case when event_id % 2 = 0 then event_type end as answer, case when event_id % 2 = 0 then least(100.0, user_id::double) end as score from events")
def finish_answers(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    text = F.when(even, F.concat(F.lit("so Finish["), "event_type", F.lit("]"))).otherwise(F.lit("go on"))
    number = F.when(even, F.concat(F.lit("score "), F.col("user_id").cast("string"))).otherwise(F.lit("none"))
    return load(spark, sf_dir, "events").select("event_id", T.finish_answer(text).alias("answer"), T.first_number(number, 0, 100).alias("score"))


@query("command_guard", "select event_id, case event_id % 5 when 0 then 'metacharacter' when 1 then 'blocked' when 2 then 'unknown program' when 3 then 'newline' end as refused from events")
def command_guard(spark, sf_dir):
    kind = F.col("event_id") % 5
    command = F.when(kind == 0, "ls; whoami").when(kind == 1, "cat /etc/passwd").when(kind == 2, "rm x").when(kind == 3, "ls\nls").otherwise("ls -l")
    return load(spark, sf_dir, "events").select("event_id", T.unsafe_command(command, ["ls", "cat"], ["passwd"]).alias("refused"))


@query("terminal_status", "select event_id, case event_type when 'error' then 'failed' when 'view' then 'timeout' else 'ok' end as status from events")
def terminal_status(spark, sf_dir):
    code = F.when(F.col("event_type") == "error", 1).otherwise(0)
    output = F.when(F.col("event_type") == "view", "command timed out").otherwise("")
    return load(spark, sf_dir, "events").select("event_id", P.terminal_status(code, output).alias("status"))


@query("default_importance", "select event_id, case when event_id % 3 = 0 then least(1.0::double, event_id % 7 / 5.0::double) else case event_id % 4 when 0 then 0.6::double when 1 then 0.8::double when 2 then 0.9::double else 0.7::double end end as importance from events")
def default_importance(spark, sf_dir):
    from skein.operators.memory import prepare

    kind = F.when(F.col("event_id") % 4 == 0, "working").when(F.col("event_id") % 4 == 1, "episodic").when(F.col("event_id") % 4 == 2, "semantic").otherwise("perceptual")
    rows = load(spark, sf_dir, "events").select("event_id", kind.alias("memory_type"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 7) / 5.0).alias("importance"), F.lit(None).cast("string").alias("modality"), F.lit(None).cast("string").alias("file_path"))
    return prepare(rows).select("event_id", "importance")


@query("score_thresholds", "select doc_id, round(n_chars % 100 / 100.0::double, 2) as relevance from documents where n_chars % 100 / 100.0::double >= 0.35::double")
def score_thresholds(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.round(F.col("n_chars") % 100 / 100.0, 2).alias("relevance")).where("relevance >= 0.35")


@query("weighted_context_score", "select event_id, round((event_id % 10 / 10.0::double) * 0.7::double + case when (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3600000000.0::double <= 24 then 1.0::double else exp(-((epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3600000000.0::double - 24) / 72) end * 0.3::double, 6) as score from events")
def weighted_context_score(spark, sf_dir):
    recency = S.context_recency(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return load(spark, sf_dir, "events").select("event_id", F.round(S.context_score((F.col("event_id") % 10) / 10.0, recency), 6).alias("score"))


@query("hit_rates", "select event_type, count(*) filter (value > 50) as hits, round((count(*) filter (value > 50))::double / count(*), 6) as hit_rate from events group by 1")
def hit_rates(spark, sf_dir):
    out = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("hits"), F.count("*").alias("n"))
    return out.select("event_type", "hits", F.round(F.try_divide("hits", "n"), 6).alias("hit_rate"))


@query("offline_embedding_search")
def offline_embedding_search(spark, sf_dir):
    """Dense search with the offline encoder: documents and questions embedded in Arrow batches."""
    encoder = P.hashing_encoder()
    docs = P.embed(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), encoder)
    asked = P.embed(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), encoder, out_col="vector")
    return R.top_k(R.dense_search(asked, docs.where("embedding is not null")), 5).select("query_id", "chunk_id", "score", "rank")


@query("triples", "select c_custkey, c_mktsegment as subject, 'is_a' as relation, 'x' || c_nationkey as object from customer")
def triples(spark, sf_dir):
    from skein.operators.graph import dialogue_triples

    text = F.concat("c_mktsegment", F.lit("是x"), F.col("c_nationkey").cast("string"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.inline(dialogue_triples(text)))


@query("pattern_relations", "select n_nationkey as memory_id, 'docker' as target, 'python' as source, 'uses' as type, 1.0::double as weight from nation")
def pattern_relations(spark, sf_dir):
    from skein.operators import graph as G

    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("memory_id"), F.lit("python使用docker").alias("content"))
    return G.pattern_relations(rows, G.mentions(rows)).where("source = 'python'").withColumn("weight", F.col("weight").cast("double"))
