"""Notes and skills: text files with a header between --- lines, read and written as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import scores as S
from skein.functions import text as T

# The kinds of notes.
KINDS = ("task_state", "conclusion", "blocker", "action", "reference", "general")


def strip(text: Column) -> Column:
    """text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def header(text: Column) -> Column:
    """map<string,string> of the key: value lines between the first two ---; empty where there is none."""
    block = F.regexp_extract(strip(text), r"(?s)^---(.*?)---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    last = F.filter(entries, lambda e: e["key"] != "")
    unique = F.transform(F.array_distinct(F.transform(last, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(last, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return F.map_from_entries(unique)


def body(text: Column) -> Column:
    trimmed = strip(text)
    return F.when(trimmed.rlike(r"(?s)^---.*?---"), strip(F.regexp_replace(trimmed, r"(?s)^---.*?---", ""))).otherwise(trimmed)


def items(value: Column) -> Column:
    """The parts of "[a, 'b', c]"."""
    parts = F.split(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\[|\]$", ""), ",")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")), lambda x: x != "")


def typed(value: Column) -> Column:
    """struct(kind, text, number, flag, list): a header's scalar as list, boolean, whole number or text."""
    low = F.lower(value)
    kind = F.when(value.rlike(r"^\[.*\]$"), "list").when(low.isin("true", "false"), "bool").when(value.rlike(r"^\d+$"), "int").otherwise("str")
    return F.struct(
        kind.alias("kind"), value.alias("text"), F.when(kind == "int", value.cast("long")).alias("number"), F.when(kind == "bool", low == "true").alias("flag"), F.when(kind == "list", items(value)).alias("list")
    )


def parse_notes(files: DataFrame) -> DataFrame:
    """(id, title, type, tags, created_at, updated_at, body) from (path, text)."""
    h = F.col("h")
    rows = files.withColumn("h", header(F.col("text")))
    return rows.select(
        F.coalesce(h["id"], F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).alias("id"), h["title"].alias("title"), F.coalesce(h["type"], F.lit("general")).alias("type"), items(h["tags"]).alias("tags"),
        F.try_to_timestamp(h["created_at"]).alias("created_at"), F.try_to_timestamp(h["updated_at"]).alias("updated_at"), body(F.col("text")).alias("body"),
    )


def parse_skills(files: DataFrame) -> DataFrame:
    """(name, description, version, tags, path, content) from the SKILL.md files among (path, text); the folder names a skill without a name."""
    h = F.col("h")
    rows = files.where(F.col("path").rlike(r"(?:^|/)SKILL\.md$")).withColumn("h", header(F.col("text")))
    return rows.select(
        F.coalesce(h["name"], F.regexp_extract("path", r"([^/]+)/SKILL\.md$", 1)).alias("name"), F.coalesce(h["description"], F.lit("")).alias("description"), F.coalesce(h["version"], F.lit("1.0.0")).alias("version"),
        items(h["tags"]).alias("tags"), "path", body(F.col("text")).alias("content"),
    )


def render(notes: DataFrame) -> DataFrame:
    """(id, text): notes in their file form."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    head = F.concat_ws("\n", F.lit("---"), line("id", F.col("id")), line("title", F.col("title")), line("type", F.col("type")), F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")), line("created_at", stamp("created_at")), line("updated_at", stamp("updated_at")), F.lit("---"))
    return notes.select("id", F.concat(head, F.lit("\n\n"), strip(F.coalesce("body", F.lit(""))), F.lit("\n")).alias("text"))


def valid(notes: DataFrame) -> DataFrame:
    """notes of a known kind with a title."""
    return notes.where(F.col("type").isin(*KINDS) & (F.trim(F.coalesce("title", F.lit(""))) != ""))


def update(notes: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """notes with the fields that changes (by id) give; a null keeps the old one, changed notes get a new time."""
    fields = ("title", "type", "tags", "body")
    new = changes.select("id", *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("changed"))
    merged = notes.join(new, "id", "left")
    return merged.select(
        "id", *[F.coalesce(F.col(f"new_{f}"), F.col(f)).alias(f) for f in fields], "created_at", F.when(F.col("changed"), as_of).otherwise(F.col("updated_at")).alias("updated_at")
    )


def search(notes: DataFrame, query: str, as_of: Column, kind: str | None = None, tags: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Notes by coverage of the query (0.7) and recency (0.3), raised by their kind; kind and tags (all of them) filter first."""
    rows = notes if kind is None else notes.where(F.col("type") == kind)
    if tags:
        rows = rows.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.col("tags"))) == 0)
    relevance = T.coverage(F.lit(query), F.concat_ws(" ", "title", "body"))
    score = S.note_score(S.context_score(relevance, S.context_recency(F.col("updated_at"), as_of)), F.col("type"))
    return rows.withColumn("relevance", relevance).where("relevance > 0").withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(max(1, min(100, limit)))


def page(notes: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    return notes.orderBy(F.col("updated_at").desc(), "id").offset(max(0, offset)).limit(max(1, min(100, limit)))


def summary(notes: DataFrame) -> DataFrame:
    """(what, name, n): notes by kind and by tag."""
    kinds = notes.groupBy(F.lit("type").alias("what"), F.col("type").alias("name")).agg(F.count("*").alias("n"))
    return kinds.unionByName(notes.select(F.explode("tags").alias("name")).groupBy(F.lit("tag").alias("what"), "name").agg(F.count("*").alias("n")))


def latest(notes: DataFrame) -> DataFrame:
    """The newest version of each id of an append-only table of notes."""
    return notes.withColumn("r_", F.row_number().over(Window.partitionBy("id").orderBy(F.col("updated_at").desc()))).where("r_ = 1").drop("r_")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    from skein.sources.files import read_texts

    return parse_notes(read_texts(spark, path, "*.md"))
