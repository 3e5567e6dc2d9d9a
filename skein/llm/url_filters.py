"""URL filters: a temporal join of captures with dated lists.

A list is a log of dated entries (list, key, day, action): from that day on a key is on the list (add) or off it (remove). A key is a host
with all below it ("ads.example.com"), or a host and the leading part of a path ("example.com/shop"). Entries become validity
intervals [day, next entry's day), and each capture is held against those that cover its fetch day: an as-of join, as the
intervals of one key and list don't overlap.

A capture's keys are its host, the host's parents and its host with each leading part of its path, so the join is an equi-join with a range
condition, and Spark can split a host that holds most captures. Keys longer than the lists' longest cannot be met and aren't made. Captures are reduced to distinct (key, day) before they
are shuffled; the verdicts return by (url, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import load

#: Days from this one on; an open interval ends far later.
START = "2024-01-01"
_OPEN = 1 << 30


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, without user, port and a final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def keys_of(url: Column, parts: int | None = None, labels: int | None = None) -> Column:
    """The keys that cover a URL: its host and its parents, of so many labels at most, and the host with up to so many leading parts of its path; None: with each."""
    host = host_of(url)
    own = F.split(host, r"\.")
    skipped = F.lit(0) if labels is None else F.greatest(F.size(own) - F.lit(labels), F.lit(0))
    none = F.array().cast("array<string>")
    parents = F.when(skipped < F.size(own), F.transform(F.sequence(skipped + 1, F.greatest(F.size(own), skipped + 1)), lambda i: F.array_join(F.slice(own, i, F.size(own)), "."))).otherwise(none)
    names = _parts(path_of(url))
    depth = F.size(names) if parts is None else F.least(F.size(names), F.lit(parts))
    paths = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(names, F.lit(1), i), "/")))).otherwise(none)
    return F.when(host == "", none).otherwise(F.array_distinct(F.concat(parents, paths)))


def entry_key(key: Column) -> Column:
    """An entry's key with its host lower-cased and without empty parts of its path; the case of a path counts, as in a URL."""
    names = _parts(F.regexp_extract(key, r"^[^/]*(?s)(.*)", 1))
    return F.array_join(F.concat(F.array(F.lower(F.regexp_extract(key, r"^[^/]*", 0))), names), "/")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, first_day, end_day) from (list, key, day, action). Of entries of one list, key and day a removal counts; rows with a null are void."""
    clean = entries.select("list", entry_key(F.col("key")).alias("key"), F.col("day").cast("int").alias("day"), (F.col("action") == "add").alias("on")).where("list is not null and key is not null and day is not null and on is not null")
    daily = clean.groupBy("list", "key", "day").agg(F.min("on").alias("on"))
    order = Window.partitionBy("list", "key").orderBy("day")
    return daily.select("list", "key", "on", F.col("day").alias("first_day"), F.coalesce(F.lead("day").over(order), F.lit(_OPEN)).alias("end_day")).where("on").drop("on")


def apply_lists(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, day, ...) with blocked, lists (names, sorted) and hits (the number of entries in force that cover it).

    A null URL, one without a host and a null day are covered by nothing. Repeated captures stay; an empty list
    blocks nothing. Columns of the result that captures has already are replaced.
    """
    captures = captures.drop("blocked", "lists", "hits")
    visits = captures.select("url", "day").where("url is not null and day is not null").distinct()
    spans = intervals(entries).select(F.col("key").alias("k"), "list", "first_day", "end_day")
    path, host = F.split("k", "/"), F.split(F.substring_index("k", "/", 1), r"\.")
    deepest = spans.agg(F.max(F.size(path) - 1).alias("parts"), F.max(F.size(host)).alias("labels")).first()
    keyed = visits.select("url", "day", F.explode(keys_of(F.col("url"), deepest.parts or 0, deepest.labels or 0)).alias("key"))
    asked = keyed.select("key", "day").distinct()
    active = asked.join(spans, (F.col("key") == F.col("k")) & (F.col("day") >= F.col("first_day")) & (F.col("day") < F.col("end_day"))).select("key", "day", "list")
    verdict = keyed.join(active, ["key", "day"]).groupBy("url", "day").agg(F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.count("*").alias("hits"))
    out = captures.join(verdict, ["url", "day"], "left")
    return out.select(*captures.columns, F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("hits", F.lit(0)).alias("hits"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of a table of pages, with a fetch day in 2024 that follows from page_id."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int").alias("day"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list for the pages' own hosts, by rule: some are listed, some leave again, some return, some only for a path."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("n", _number(F.col("host")))
    listed = hosts.where("n % 4 = 0")
    start = (F.col("n") % 300).cast("int")
    add = listed.select(F.lit("spam").alias("list"), F.col("host").alias("key"), start.alias("day"), F.lit("add").alias("action"))
    gone = listed.where("n % 8 = 0").select(F.lit("spam").alias("list"), F.col("host").alias("key"), (start + 20).alias("day"), F.lit("remove").alias("action"))
    back = listed.where("n % 16 = 0").select(F.lit("spam").alias("list"), F.col("host").alias("key"), (start + 45).alias("day"), F.lit("add").alias("action"))
    path = hosts.where("n % 5 = 0").select(F.lit("adult").alias("list"), F.concat("host", F.lit("/en")).alias("key"), F.lit(30).alias("day"), F.lit("add").alias("action"))
    parent = hosts.where("n % 7 = 0").select(F.lit("parked").alias("list"), F.regexp_replace("host", r"^[^.]*\.", "").alias("key"), F.lit(100).alias("day"), F.lit("add").alias("action"))
    ends = parent.where("key not like 'example.%'").withColumn("day", F.lit(260)).withColumn("action", F.lit("remove"))
    # Whole paths of some pages, as deep as they are, and places below them that no page has.
    name = F.concat(F.concat_ws("/", F.array(host_of(F.col("url"))), _parts(path_of(F.col("url")))), F.when(_number(F.col("url")) % 18 == 0, F.lit("/below/that/place")).otherwise(F.lit("")))
    deep = pages.where((host_of(F.col("url")) != "") & (_number(F.col("url")) % 9 == 0)).select(F.lit("deep").alias("list"), name.alias("key"), F.lit(5).alias("day"), F.lit("add").alias("action")).distinct()
    return add.unionByName(deep).unionByName(gone).unionByName(back).unionByName(path).unionByName(parent.where("key not like 'example.%'")).unionByName(ends)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture's verdict at its fetch day."""
    pages = load(spark, sf_dir, "pages")
    out = apply_lists(captures_of(pages), sample_entries(pages))
    return out.select("page_id", host_of(F.col("url")).alias("host"), "day", "blocked", "lists", "hits")


OP8_SQL = r"""
with p as (select page_id, url, cast((page_id * 7919) % 366 as int) as day,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1) as path from pages),
h as (select distinct host, cast('0x' || substr(md5(host), 1, 7) as bigint) as n from p where host <> ''),
e as (
    select 'spam' as list, host as key, cast(n % 300 as int) as day, 1 as act from h where n % 4 = 0
    union all select 'spam', host, cast(n % 300 as int) + 20, 0 from h where n % 8 = 0
    union all select 'spam', host, cast(n % 300 as int) + 45, 1 from h where n % 16 = 0
    union all select 'adult', host || '/en', 30, 1 from h where n % 5 = 0
    union all select 'parked', regexp_replace(host, '^[^.]*\.', ''), 100, 1 from h where n % 7 = 0 and regexp_replace(host, '^[^.]*\.', '') not like 'example.%'
    union all select 'parked', regexp_replace(host, '^[^.]*\.', ''), 260, 0 from h where n % 7 = 0 and regexp_replace(host, '^[^.]*\.', '') not like 'example.%'
    union all select distinct 'deep', array_to_string(list_concat([host], list_filter(string_split(path, '/'), lambda x: x <> '')), '/') || case when n % 18 = 0 then '/below/that/place' else '' end, 5, 1
        from (select host, path, cast('0x' || substr(md5(url), 1, 7) as bigint) as n from p) where host <> '' and n % 9 = 0),
daily as (select list, key, day, min(act) as act from e group by all),
k as (
    select distinct url, day, array_to_string(list_slice(labels, i, len(labels)), '.') as key
    from (select url, day, labels, unnest(range(1, len(labels) + 1)) as i from (select url, day, string_split(host, '.') as labels from p where host <> ''))
    union
    select distinct url, day, host || '/' || array_to_string(list_slice(names, 1, i), '/')
    from (select url, day, host, names, unnest(range(1, len(names) + 1)) as i from (select url, day, host, list_filter(string_split(path, '/'), lambda x: x <> '') as names from p where host <> ''))),
lists as (select distinct list from daily),
asked as (select k.url, k.day, k.key, lists.list from k cross join lists),
found as (select a.url, a.day, a.list, d.act from asked a asof join daily d on a.list = d.list and a.key = d.key and a.day >= d.day),
v as (select url, day, string_agg(distinct list, ',' order by list) as lists, count(*) as hits from found where act = 1 group by all)
select p.page_id, p.host, p.day, v.lists is not null as blocked, coalesce(v.lists, '') as lists, coalesce(v.hits, 0) as hits
from p left join v on p.url = v.url and p.day = v.day
"""
