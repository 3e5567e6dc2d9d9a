"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its lower-cased words with their counts as weights; a text without words has the empty word once. For sample k a
term's hash gives r, c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) the term's value is

    ln a = ln c - r (t - b + 1)

and the sample is the term (with its t) of the least value. Two texts have the same sample with a probability equal to the generalised
Jaccard similarity of their weighted terms. The least value identifies the term and t, so a fingerprint is the
SAMPLES least values and a likeness the share of equal ones.

The documents are dealt once, by ranges of doc_id, so that a document and its successor meet in a task; counting words, the
least values and the comparison with the successor all keep that partitioning. The number of ranges grows with the table (rows_per_range), an id that
many rows share is dealt further by a hash of its texts, and the ranges' bounds (one long a range) are the only thing that reaches the driver. Each range
gets its lower neighbour's first document as a guest, so no window spans more than a range and there is no global order. Rows that repeat as a whole stay in
one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import load

SAMPLES = 32
ROWS_PER_RANGE = 1_000
#: Ranges whose bounds come from one pass; more are bounded in two, the second within the ranges of the first.
FAN = 4_096
_LEAST = -(1 << 63)
_SUB_BITS = 20


def _uniform(h: Column, shift: int) -> Column:
    """21 bits of a hash, strictly between 0 and 1."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) / F.lit(float(1 << 21))


def sample_value(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of a term (a hash) in sample k."""
    h = F.xxhash64(term, F.lit(k))
    g = F.xxhash64(term, F.lit(-1 - k))
    r = -F.ln(_uniform(h, 0) * _uniform(h, 21))
    c = -F.ln(_uniform(h, 42) * _uniform(g, 0))
    b = _uniform(g, 21) + F.shiftrightunsigned(g, 42) / F.lit(float(1 << 43))
    return F.ln(c) - r * (F.floor(log_weight / r + b) - b + F.lit(1.0))


def words(text: Column) -> Column:
    """Runs of anything but white space, lower-cased; one empty word where there is none."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")


def _weighed(rows: DataFrame, keys: list[str], text: str, samples: int) -> DataFrame:
    """The least values s0, s1, ... of each (keys), whose rows must already be together."""
    terms = rows.select(*keys, F.explode(words(F.col(text))).alias("word")).select(*keys, F.xxhash64("word").alias("term"))
    counted = terms.groupBy(*keys, "term").agg(F.count("*").alias("n")).select(*keys, "term", F.ln(F.col("n").cast("double")).alias("lw"))
    return counted.groupBy(*keys).agg(*[F.min(sample_value(F.col("term"), F.col("lw"), k)).alias(f"s{k}") for k in range(samples)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, samples array<double>) for each distinct (id, text): a null text is empty, an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).distinct()
    rows = rows.repartition("id", "h")
    out = _weighed(rows, ["id", "h"], "t", samples)
    return out.select("id", F.array(*[f"s{k}" for k in range(samples)]).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def _text(samples: list[Column]) -> Column:
    """A fingerprint's samples, 16 hex digits each, from the bits of its values."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(s))), 16, "0") for s in samples])


def rows_per_range(total: int) -> int:
    """ROWS_PER_RANGE up to 2**26 rows, from there on growing as the root of the total: 27 times as many for 5 * 10**10."""
    return max(1, int(ROWS_PER_RANGE * max(1.0, total / (1 << 26)) ** 0.5))


def _array(values: list[int]) -> Column:
    """A literal array of longs, folded from one string, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _below(values: list[int], key: Column) -> Column:
    """How many of the sorted values are less than key: a binary search, one lambda step for each bit of their number."""
    if not values:
        return F.lit(0)
    held = _array(values)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(values).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(held, at + step - 1) < key, F.lit(False)), at + step).otherwise(at))


def _bounds(rows: DataFrame, ranges: int) -> list[int]:
    """Keys that cut the rows into about so many ranges of equal size."""

    def cuts(n: int) -> Column:
        return F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)

    if ranges < 2:
        return []
    if ranges <= FAN:
        return sorted(set(rows.agg(cuts(ranges).alias("q")).first().q or []))
    outer = int(-(-ranges // FAN)) if ranges <= FAN * FAN else FAN
    first = sorted(set(rows.agg(cuts(max(2, outer)).alias("q")).first().q or []))
    inner = rows.groupBy(_below(first, F.col("key")).alias("part")).agg(cuts(FAN).alias("q")).select(F.explode("q").alias("q")).distinct()
    return sorted({*first, *(r.q for r in inner.collect())})


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, place, guest, id, text, next_text): rows in descending order of id with the text of the one after, the first one's after the last.

    Rows of one id follow each other by a hash of their text; null ids come last. Guests (guest = 1) close each range
    and are the next range's first row; they are no documents of their own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.count()
    size = rows_per_range(total)
    # Ids with the rows of several ranges: fewer than there are ranges. Each gets a range of its own, cut by the leading bits of the texts' hashes.
    hot = sorted((r.key, min(_SUB_BITS, (r.n // size).bit_length())) for r in rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * size).collect()) if total > 2 * size else []
    bounds = sorted({*_bounds(rows, -(-total // size)), *(x for k, _ in hot for x in (max(k - 1, _LEAST), k))})
    part = _below(bounds, F.col("key")).cast("long")
    sub: Column = F.lit(0).cast("long")
    if hot:
        keys, bits = [k for k, _ in hot], [b for _, b in hot]
        at = _below(keys, F.col("key"))
        depth = F.when(F.get(_array(keys), at) == F.col("key"), F.get(_array(bits), at)).otherwise(F.lit(0)).cast("int")
        # The hash's order is kept: its leading bits, counted from the least.
        sub = F.when(depth > 0, F.call_function("shiftright", F.shiftright(F.xxhash64("text"), 1) + F.lit(1 << 62), F.lit(63) - depth)).otherwise(sub)
    rows = rows.withColumn("part", part * (1 << _SUB_BITS) + sub)
    heads = rows.groupBy("part").agg(F.max("key").alias("key")).collect()  # one row a range
    if not heads:
        return spark.createDataFrame([], "part long, place int, guest int, id long, text string, next_text string")
    # Ranges in the order of their rows: descending keys, and within one key ascending hashes. The last is followed by the first.
    heads.sort(key=lambda h: (-(h.part >> _SUB_BITS), h.part))
    follows = spark.createDataFrame([(h.part, after.part, after.key) for h, after in zip(heads, [*heads[1:], heads[0]], strict=True)], "host long, part long, key long")
    first = rows.join(F.broadcast(follows), ["part", "key"]).select("host", "key", "text")
    guests = first.groupBy("host").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("g")).select(
        F.lit(_LEAST).alias("key"), F.lit(None).cast("long").alias("id"), F.col("g.text").alias("text"), F.col("host").alias("part"), F.lit(1).alias("guest")
    )
    full = rows.withColumn("guest", F.lit(0)).unionByName(guests).repartition(len(heads), "part")
    order = Window.partitionBy("part").orderBy("guest", F.col("key").desc(), F.xxhash64("text"))
    return full.select("part", F.row_number().over(order).alias("place"), "guest", "id", "text", F.lead("text").over(order).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many of the following text, or all it has."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(text.substr(F.lit(1), n - half), following.substr(F.lit(1), half))


def op5_fingerprints(spark: SparkSession, sf_dir: str, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; the successor's too."""
    rows = with_successors(load(spark, sf_dir, "documents"))
    change = edited(F.col("text"), F.coalesce("next_text", F.lit("")))
    facts = rows.where("guest = 0").select("part", "place", F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2(change.cast("binary"), 256).alias("edited_sha256"))
    # Variant 0 is the text, 1 the edited one; a guest has only its text.
    texts = F.when(F.col("guest") == 1, F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")))).otherwise(
        F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), change.alias("t")))
    )
    # doc_id goes along so that this reads the same columns as `facts`: Spark then deals the texts out once for both.
    both = rows.select("part", "place", F.col("id").alias("doc_id"), F.inline(texts))
    prints = _weighed(both, ["part", "place", "doc_id", "v"], "t", samples)
    order = Window.partitionBy("part").orderBy("place", "v")
    names = [f"s{k}" for k in range(samples)]
    near = lambda step: sum((F.when(F.col(s) == F.lead(s, step).over(order), 1).otherwise(0) for s in names), F.lit(0)) / F.lit(float(samples))
    own = _text([F.col(s) for s in names])
    compared = prints.select(
        "part", "place", "v", own.alias("fingerprint"), F.lead(own).over(order).alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next")
    ).where("v = 0").drop("v")
    return facts.join(compared, ["part", "place"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
