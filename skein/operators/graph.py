"""A light knowledge graph: entities, co-occurrence and pattern edges, and scores by one-hop joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.lexicons import TECH_ENTITIES


# Fixed values, on which results depend: the verbs, lengths and quotes below, the 20 characters after a verb, and the weights of edges and scores.


def entity_names(text: Column) -> Column:
    """Known technical words, capitalised Latin words, CJK subjects and targets of a few patterns, quoted strings; first of equal ones kept."""
    words = F.array(*[F.lit(w) for w in TECH_ENTITIES])
    known = F.transform(F.array(F.lower(text)), lambda low: F.filter(words, lambda w: F.contains(low, w)))[0]  # the text is lower-cased once, not for each word
    proper = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zA-Z]{2,})\b"), F.lit(1))
    subject = [F.regexp_extract_all(text, F.lit(f"([一-鿿]{{2,8}}){verb}"), F.lit(1)) for verb in ("是(?:一种|一个|一类)?", "使用", "包含", "属于", "支持", "提供了")]
    target = F.regexp_extract_all(text, F.lit("是(?:一种|一个|一类)?([一-鿿]{2,8})"), F.lit(1))
    patterns = F.when(text.rlike("[一-鿿]"), F.concat(*subject, target)).otherwise(F.array().cast("array<string>"))  # one look at a text without CJK, not seven
    quoted = F.filter(F.regexp_extract_all(text, F.lit("[「\"'](.+?)[」\"']"), F.lit(1)), lambda q: F.length(q) >= 2)
    # The known words are bound once, not looked for again for each of the others.
    return F.transform(F.array(known), lambda k: F.array_distinct(F.concat(k, F.filter(proper, lambda p: ~F.array_contains(k, F.lower(p))), patterns, quoted)))[0]


def entity_type(name: Column) -> Column:
    table = F.create_map(*[x for k, v in TECH_ENTITIES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, F.lower(name)), F.when(name.rlike("^[A-Z][a-zA-Z]+$"), "person").otherwise("concept"))


def mentions(memories: DataFrame, id_col: str = "memory_id", text_col: str = "content", limit: int | None = None) -> DataFrame:
    """(memory_id, key, name): a row for each distinct entity of a memory; keys are lower-cased names."""
    names = entity_names(F.col(text_col))
    # From a plain explode Spark derives filters (not null, not empty) that evaluate the names twice more.
    long = memories.select(F.col(id_col).alias("memory_id"), F.explode_outer(names if limit is None else F.slice(names, 1, limit)).alias("name")).where("name is not null")
    return long.groupBy("memory_id", F.lower("name").alias("key")).agg(F.min("name").alias("name"))


#: Mentions of a task of dealt.
TASK_MENTIONS = 250_000


def dealt(found: DataFrame) -> DataFrame:
    """Stored mentions by memory, so many to a task: adaptive execution would join them to a few large tasks, and what these hold grows with the table."""
    return found.repartition(max(1, -(-found.count() // TASK_MENTIONS)), "memory_id")


def entities(found: DataFrame) -> DataFrame:
    """(key, name, type, memories): each entity with the number of memories that name it."""
    return found.groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("memories")).withColumn("type", entity_type(F.col("name")))


def memory_ids(found: DataFrame) -> DataFrame:
    return found.groupBy("key").agg(F.sort_array(F.collect_set("memory_id")).alias("memory_ids"))


def cooccurrence(found: DataFrame, weight: float = 0.5) -> DataFrame:
    """An edge for each pair of entities of one memory, in order of their keys: n (n - 1) / 2 rows of a memory with n entities, since every one is an edge.

    mentions(limit=n) bounds that where only a memory's first n entities are to count; edges_at gives the edges of some entities without the others'.
    """
    a, b = found.select("memory_id", F.col("key").alias("source")), found.select("memory_id", F.col("key").alias("target"))
    return a.join(b, "memory_id").where("source < target").withColumn("type", F.lit("co_occurrence")).withColumn("weight", F.lit(weight))


def edge_counts(found: DataFrame, folder: str, least: int = 2, weight: float = 0.5) -> DataFrame:
    """(source, target, n, weight): cooccurrence's edges that at least so many memories have, counted, their weights summed. folder: where found is stored, since it is read twice.

    A pair is in no more memories than its rarer end, so entities of fewer memories, which are most of the names, are left out before pairs are made.
    """
    found.select("memory_id", "key").write.parquet(folder)
    stored = found.sparkSession.read.parquet(folder)
    often = stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")
    edges = cooccurrence(stored.join(often, "key", "left_semi"), weight)
    return edges.groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).where(F.col("n") >= least)


def edges_at(found: DataFrame, keys: DataFrame, weight: float = 0.5) -> DataFrame:
    """cooccurrence's edges with an end among keys (key). Only the asked entities meet the others of their memories, so rows grow with these, not with all pairs."""
    asked = found.join(keys.select("key").distinct(), "key", "left_semi").select("memory_id", F.col("key").alias("one"))
    met = asked.join(found.select("memory_id", F.col("key").alias("other")), "memory_id").where("one <> other")
    each = met.select("memory_id", F.least("one", "other").alias("source"), F.greatest("one", "other").alias("target")).distinct()
    return each.withColumn("type", F.lit("co_occurrence")).withColumn("weight", F.lit(weight))


def pattern_relations(memories: DataFrame, found: DataFrame, text_col: str = "content") -> DataFrame:
    """is_a, uses and related_to edges between entities of one memory, by what stands after or between their names."""
    text = memories.select("memory_id", F.lower(text_col).alias("text"))
    pairs = found.select("memory_id", F.col("key").alias("source")).join(found.select("memory_id", F.col("key").alias("target")), "memory_id").where("source <> target").join(text, "memory_id")
    piece = lambda verb: F.when(F.contains(F.col("text"), F.concat(F.col("source"), F.lit(verb))), F.substr(F.col("text"), F.position(F.concat(F.col("source"), F.lit(verb)), F.col("text")) + F.length("source") + len(verb), F.lit(20)))
    holds = lambda verb: F.coalesce(F.contains(piece(verb), F.col("target")), F.lit(False))
    near = F.lit(False)
    for joint in ("与", "和"):
        rest = F.when(F.contains(F.col("text"), F.concat(F.col("source"), F.lit(joint))), F.substr(F.col("text"), F.position(F.concat(F.col("source"), F.lit(joint)), F.col("text")) + F.length("source") + 1, F.length("target") + 5))
        near = near | F.coalesce(F.contains(rest, F.col("target")), F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when(holds("是"), F.struct(F.lit("is_a").alias("type"), F.lit(1.0).alias("weight"))),
            F.when(holds("使用") | holds("利用") | holds("用"), F.struct(F.lit("uses").alias("type"), F.lit(1.0).alias("weight"))),
            F.when(near, F.struct(F.lit("related_to").alias("type"), F.lit(0.8).alias("weight"))),
        )
    )
    return pairs.select("memory_id", "source", "target", F.inline(kinds))


def graph_scores(query_keys: DataFrame, found: DataFrame, edges: DataFrame) -> DataFrame:
    """(memory_id, score) for one query's entity keys: Jaccard of entities * 0.6 + linked edges * 0.4, at most 1.

    An edge counts if one end is asked for and the other is in the memory: 0.3 of its weight if it comes from that memory, else 0.15. The weights
    are summed by their other end (over all memories, and from the memory itself) before they meet the memories, so an entity that many memories
    name costs a row of each, not a row of each pair. An edge with both ends asked for and in the memory is met twice; one of the two is taken off.
    """
    keys = F.broadcast(query_keys.select(F.col("key")).distinct())
    asked = keys.count()
    overlap = found.join(keys, "key").groupBy("memory_id").agg(F.count("*").alias("shared"))
    sizes = found.groupBy("memory_id").agg(F.count("*").alias("size"))
    each = edges.select("memory_id", "source", "target", "type", "weight").distinct()
    from_source = each.join(keys.withColumnRenamed("key", "source"), "source", "left_semi")
    from_target = each.join(keys.withColumnRenamed("key", "target"), "target", "left_semi")
    twice = from_source.join(keys.withColumnRenamed("key", "target"), "target", "left_semi")
    ends = from_source.select("memory_id", F.col("target").alias("key"), "weight").unionByName(from_target.select("memory_id", F.col("source").alias("key"), "weight"))
    own = ends.groupBy("memory_id", "key").agg(F.sum("weight").alias("own"))
    anywhere = ends.groupBy("key").agg(F.sum("weight").alias("all"))
    met = found.select("memory_id", "key").join(anywhere, "key").join(own, ["memory_id", "key"], "left").select("memory_id", (0.15 * (F.col("all") + F.coalesce("own", F.lit(0.0)))).alias("part"))
    named = found.select("memory_id", "key").join(keys, "key", "left_semi")
    pairs = named.select("memory_id", F.col("key").alias("source")).join(named.select("memory_id", F.col("key").alias("target")), "memory_id")
    own = twice.groupBy("memory_id", "source", "target").agg(F.sum("weight").alias("own"))
    anywhere = F.broadcast(twice.groupBy("source", "target").agg(F.sum("weight").alias("all")))  # pairs of asked keys
    over = pairs.join(anywhere, ["source", "target"]).join(own, ["memory_id", "source", "target"], "left").select("memory_id", (-0.15 * (F.col("all") + F.coalesce("own", F.lit(0.0)))).alias("part"))
    linked = met.unionByName(over).groupBy("memory_id").agg(F.sum("part").alias("links"))
    joined = sizes.join(overlap, "memory_id", "left").join(linked, "memory_id", "left")
    shared, links = F.coalesce("shared", F.lit(0)), F.coalesce("links", F.lit(0.0))
    score = shared / (F.col("size") + asked - shared) * 0.6 + links * 0.4
    return joined.select("memory_id", F.least(F.lit(1.0), score).alias("score")).where("score > 0")


def relations_of(edges: DataFrame, key: str) -> DataFrame:
    return edges.where((F.lower("source") == key.lower()) | (F.lower("target") == key.lower()))


def dialogue_triples(text: Column) -> Column:
    """Distinct (subject, relation, object) of "X是Y", "X包括/包含/分为Y" sentences."""
    is_a = F.regexp_extract_all(text, F.lit(r"(?U)([\w]{2,20})是([\w]{2,30})"), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(r"(?U)([\w]{2,20})(?:包括|包含|分为)([\w]{2,30})"), F.lit(0))
    cut = lambda s, verb, name: F.struct(F.regexp_extract(s, rf"(?U)^([\w]{{2,20}}?)(?:{verb})", 1).alias("subject"), F.lit(name).alias("relation"), F.regexp_extract(s, rf"(?U)(?:{verb})([\w]{{2,30}})$", 1).alias("object"))
    return F.array_distinct(F.concat(F.transform(is_a, lambda s: cut(s, "是", "is_a")), F.transform(parts, lambda s: cut(s, "包括|包含|分为", "includes"))))
