"""Text, chunking, catalogue, streaming and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import chunking as C
from skein.operators import sqlgate as G
from skein.plans.registry import query
from skein.session import load
from skein.streaming import state as ST
from skein.streaming import timers as ET
from skein.streaming import windows as W


@query("token_estimate", r"select doc_id, case when text = '' then 0 else len(regexp_extract_all(text, '\S+')) end as tokens from documents")
def token_estimate(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("sentence_split", r"select doc_id, len(list_filter(regexp_extract_all(text, '[^.!?;]*[.!?;]|[^.!?;]+$'), lambda s: trim(s, e' \t\n\r') <> '')) as sentences from documents")
def sentence_split(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(T.sentences(F.col("text")), lambda s: s.rlike(r"\S"))).cast("long").alias("sentences"))


@query("tokenize", "select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as n, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) as digest from documents")
def tokenize(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("title_extract", r"""with f as (select doc_id, regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '^[#*]+\s*', '') as t from documents)
select doc_id, case when length(t) > 3 and length(t) < 100 then t end as title from f""")  # fmt: skip
def title_extract(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.title(F.col("text")).alias("title"))


_CLASSES = {"notice": ["license", "copyright", "version"], "contact": ["@", "http", "www"], "insult": ["idiot", "stupid", "moron"], "junk": ["***", "&&&", "%%%"]}
_CLASS_SCORES = ", ".join("(" + " + ".join(f"contains(lower(text), '{w}')::int" for w in words) + f") as s{k}" for k, words in enumerate(_CLASSES.values()))
_CLASS_CASE = " ".join(f"when s{k} = top then '{name}'" for k, name in enumerate(_CLASSES))


@query("doc_type_classify", f"with s as (select doc_id, {_CLASS_SCORES} from documents), t as (select *, greatest(s0, s1, s2, s3) as top from s) select doc_id, case when top = 0 then 'general' {_CLASS_CASE} end as doc_type from t")
def doc_type_classify(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.best_class(F.col("text"), _CLASSES, "general").alias("doc_type"))


_TAGS = ["License", "Apache", "GNU", "idiot", "the", "und", "pour"]


@query("auto_tags", f"select doc_id, array_to_string(list_filter({_TAGS}, lambda t: contains(lower(text), lower(t))), ',') as tags from documents")
def auto_tags(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tags(F.col("text"), _TAGS), ",").alias("tags"))


@query("query_parse", f"with s as (select item_id, text, {_CLASS_SCORES} from benchmark), t as (select *, greatest(s0, s1, s2, s3) as top from s), d as (select item_id, text, case when top = 0 then null {_CLASS_CASE} end as doc_type from t) select item_id, doc_type, text as cleaned from d where doc_type is null")
def query_parse(spark, sf_dir):
    return query_parse_all(spark, sf_dir).where("doc_type is null")


@query("query_parse_all")
def query_parse_all(spark, sf_dir):
    """Every item with its class, whose words are taken out. Has no SQL; that of query_parse is for items without a class."""
    kind = T.best_class(F.col("text"), _CLASSES, None)
    return load(spark, sf_dir, "benchmark").select("item_id", kind.alias("doc_type"), T.clean_query(F.col("text"), kind, _CLASSES).alias("cleaned"))


@query("clip_preview", "select doc_id, case when length(text) > 120 then substr(text, 1, 120) || '...' else text end as preview from documents")
def clip_preview(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text"), 120).alias("preview"))


@query("distinct_variants", "select n_regionkey, array_to_string(list_distinct(list_transform(list(n_name order by n_nationkey), lambda x: substr(x, 1, 1))), '') is not null as ok, len(list_distinct(list_transform(list(n_name), lambda x: substr(x, 1, 1)))) as n from nation group by 1")
def distinct_variants(spark, sf_dir):
    names = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.substring("n_name", 1, 1)).alias("v"))
    return names.select("n_regionkey", F.lit(True).alias("ok"), F.size(T.distinct_variants(F.col("v"))).cast("long").alias("n"))


_EXTENSIONS = ["png", "MP4", "mp3", "py", "txt", "pdf", "json", "xyz", ""]


@query("modality_by_extension", f"""with n as (select event_id, lower({_EXTENSIONS}[(event_id * 7 + user_id) % 9 + 1]) as e from events)
select event_id, case when e = 'png' then 'image' when e = 'mp4' then 'video' when e = 'mp3' then 'audio' when e = 'py' then 'code' when e = 'pdf' then 'document' when e = 'json' then 'data' else 'text' end as modality from n""")  # fmt: skip
def modality_by_extension(spark, sf_dir):
    """Files named after the events, with extensions of every modality, unknown ones and none."""
    from skein.functions.lexicons import MODALITY_BY_EXTENSION

    extension = F.get(F.array(*[F.lit(e) for e in _EXTENSIONS]), ((F.col("event_id") * 7 + F.col("user_id")) % 9).cast("int"))
    path = F.concat(F.lit("/files.v2/"), F.col("event_type"), F.when(extension == "", "").otherwise(F.concat(F.lit("."), extension)))
    return load(spark, sf_dir, "events").select("event_id", T.by_extension(path, MODALITY_BY_EXTENSION).alias("modality"))


@query("page_text", r"select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'))) as digest from pages")
def page_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(C.visible_lines(F.col("html"))).alias("digest"))


@query("markdown_blocks", """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from (select conv_id as doc_id, string_agg(case when role = 'user' then '# ' || turn || chr(10) || text else text end, chr(10) order by turn) as text from conversations group by 1)),
m as (select *, regexp_matches(line, '^#{1,6}\\s+\\S') as h, sum(regexp_matches(line, '^#{1,6}\\s+\\S')::int) over (partition by doc_id order by pos) as block from l)
select doc_id as id, block::bigint as block, coalesce(min(trim(regexp_replace(line, '^#{1,6}\\s+', ''))) filter (h), '全文') as section, len(string_split(trim(string_agg(line, chr(10) order by pos), e' \\n'), chr(10))) as lines from m group by 1, 2 having trim(string_agg(line, chr(10) order by pos), e' \\n') <> ''""")  # fmt: skip
def markdown_blocks(spark, sf_dir):
    part = F.when(F.col("role") == "user", F.concat(F.lit("# "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    docs = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    blocks = C.markdown_blocks(docs, "conv_id", "text")
    return blocks.select("id", "block", "section", F.size(F.split("content", "\n")).cast("long").alias("lines"))


@query("image_refs", """with d as (select doc_id as id, '![' || lang || '](img/' || source || '.png) ![again](img/' || source || '.png)' as text from documents) select id, regexp_extract(text, '!\\[([^\\]]*)\\]', 1) as alt, regexp_extract(text, '\\(([^)]+)\\)', 1) as path from d""")
def image_refs(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("!["), "lang", F.lit("](img/"), "source", F.lit(".png) ![again](img/"), "source", F.lit(".png)")).alias("text"))
    return C.image_references(d, "doc_id", "text")


@query("front_matter", """select doc_id as id, 'Title ' || doc_id as title, lang as type, lang || ',' || source as tags, trim(text, e' ') as body from documents where text not like '%---%' and text = trim(text)""")
def front_matter(spark, sf_dir):
    from skein.sources.notes import parse_notes

    d = load(spark, sf_dir, "documents").withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source", "text")})
    raw = d.select(F.lit("x.md").alias("path"), F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\ntitle: Title "), F.col("doc_id").cast("string"), F.lit("\ntype: "), "lang", F.lit("\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\n---\n\n"), "text").alias("text"))
    return parse_notes(raw).select(F.col("id").cast("long").alias("id"), "title", "type", F.array_join("tags", ",").alias("tags"), "body")


@query("chunk_chars")
def chunk_chars(spark, sf_dir):
    """Chunks of at most 500 characters; packing has no SQL form."""
    return C.character_chunks(load(spark, sf_dir, "documents"), "doc_id", "text").select("id", "chunk_index", "tokens", F.length("content").alias("chars"))


@query("chunk_tokens")
def chunk_tokens(spark, sf_dir):
    """Chunks of at most 200 tokens with overlap; packing has no SQL form."""
    return C.token_chunks(load(spark, sf_dir, "documents"), "doc_id", "text").select("id", "chunk_index", "tokens", "paragraphs")


_ASKED = ["order", "key", "text", "id", "date"]
_NAMED = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("table_match", f"""with c as (select table_name, column_name from information_schema.columns where table_name in ({', '.join(f"'{t}'" for t in _NAMED)})), k as (select unnest({_ASKED}) as k),
n as (select table_name, sum(case when contains(lower(table_name), k) then 10 else 0 end) as s from (select distinct table_name from c), k group by 1), m as (select table_name, sum(case when contains(lower(column_name), k) then 3 else 0 end) as s from c, k group by 1)
select n.table_name as "table", (n.s + m.s)::int as score from n join m using (table_name)""")  # fmt: skip
def table_match(spark, sf_dir):
    """How well each of the given tables answers to some key words, by its name and its columns'."""
    tables = [G.Table(name, [G.Column_(c, kind) for c, kind in load(spark, sf_dir, name).dtypes]) for name in _NAMED]
    return G.table_scores(spark, tables, _ASKED).select("table", F.col("score").cast("int").alias("score"))


@query("catalog_columns", "select 'n_name' as name, 'varchar' = 'varchar' as known union all select 'n_nationkey', true union all select 'n_regionkey', true")
def catalog_columns(spark, sf_dir):
    load(spark, sf_dir, "nation").createOrReplaceTempView("catalogue_nation")
    found = next(t for t in G.catalogue(spark) if t.name == "catalogue_nation")
    return spark.createDataFrame([(c.name, bool(c.type)) for c in found.columns], "name string, known boolean")


@query("sql_gateway", "select n_regionkey, count(*) as n from nation group by 1 order by 1 limit 20")
def sql_gateway(spark, sf_dir):
    """A model's fenced answer through the guard, with the limit it lacks."""
    load(spark, sf_dir, "nation").createOrReplaceTempView("gateway_nation")
    answer = "```sql\nselect n_regionkey, count(*) as n from gateway_nation group by n_regionkey order by n_regionkey;\n```"
    return G.run_sql(spark, G.extract_sql(answer))


_DUCK_WINDOW = "select {start} as start, {start} + interval '{size}' as \"end\", event_type, count(*) as n, round(sum(value), 4) as total from events{extra} group by all"


@query("stream_tumbling", _DUCK_WINDOW.format(start="date_trunc('day', ts)", size="1 day", extra=""))
def stream_tumbling(spark, sf_dir):
    out = W.drain(W.windowed(W.event_stream(spark, sf_dir), F.window("ts", "1 day"), ["event_type"]))
    return _naive(out)


@query("stream_sliding", _DUCK_WINDOW.format(start="time_bucket(interval '6 hours', ts, timestamp '2000-01-01') - k * interval '6 hours'", size="1 day", extra=", unnest([0, 1, 2, 3]) as u(k)"))
def stream_sliding(spark, sf_dir):
    return _naive(W.drain(W.windowed(W.event_stream(spark, sf_dir), F.window("ts", "1 day", "6 hours"), ["event_type"])))


def _naive(out):
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "total")


@query("batch_sessions", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from g)
select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) as n from s group by user_id, s""")  # fmt: skip
def batch_sessions(spark, sf_dir):
    s = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query("stream_first_seen", "select event_type, count(*) as n from events group by 1")
def stream_first_seen(spark, sf_dir):
    """Events by type, each told three times, after de-duplication by id within the watermark."""
    told = W.event_stream(spark, sf_dir).select("event_id", "event_type", "ts").withColumn("time", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("time")
    seen = W.drain(W.first_seen(told, ["event_id"]), "append")
    return seen.groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_sessions", """with b as (select user_id::varchar as key, ts, value, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 7200000000 then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by key order by ts rows unbounded preceding) as k from b), t as (select key, min(ts) as "start", max(ts) as "end", count(*) as n, round(sum(value), 4) as total from s group by key, k)
select * from t where epoch_ms("end") + 7200001 <= (select epoch_ms(max(ts)) - 3600000 from events)""")  # fmt: skip
def stream_sessions(spark, sf_dir):
    """Sessions of every user, two hours apart, closed by event-time timers; those that the watermark has not passed are still open."""
    rows = W.drain(ET.sessions(W.event_stream(spark, sf_dir), "user_id", 7200), "append")
    return rows.select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


@query("stream_breaker")
def stream_breaker(spark, sf_dir):
    """A breaker for each user's events, errors as failures."""
    e = W.event_stream(spark, sf_dir, files_a_batch=1000)
    calls = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.unix_micros("ts").cast("double").alias("ts"), (F.col("event_type") != "error").alias("ok")).withColumn("ts", F.col("ts") / 1e6)
    out = W.drain(ST.breaker_stream(calls, 2, 86400.0), "update")
    latest = out.groupBy("key").agg(F.max_by(F.struct("calls", "passed", "refused", "opened", "state"), "calls").alias("x"))
    return latest.select("key", "x.*")


@query("memory_ttl", "select event_id from events where ts > timestamp '2024-01-31 00:00:00' - interval 14400 minute")
def memory_ttl(spark, sf_dir):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return load(spark, sf_dir, "events").where(F.col("ts").isNull() | (F.col("ts") > as_of - F.expr("interval 14400 minutes"))).select("event_id")
