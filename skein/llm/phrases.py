"""Phrase collocation mining by hashed bucket counts (PCY, DHP) and Apriori pruning.

Pass k counts phrases of k words exactly and, in the same reading of the texts, counts phrases of k + 1 words by hash bucket. The buckets that reach the
threshold become a bitmap, and so do the phrases of k words that do (by the same hash). Both bitmaps go to every task of pass k + 1, which counts a phrase only
if its bucket and both its parts of k words are marked. A bitmap errs on one side only: what it lets through is counted exactly, so results are
those of a full count.

Bitmaps have 2**bits marks, chosen by the size of the corpus and 2**25 (4 MB) at most; beyond that they let more phrases through and nothing else changes.
Bucket counts stop at the threshold, so they take a byte a bucket in a task. Tasks count runs of about a million words before they send phrases on,
so a frequent phrase is a row for each run, and Spark adds the runs' counts up where they are before it shuffles. Within a run words and phrases are
the arithmetic of arrays: they are told apart by two hashes of 64 bits each, and spelt out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import bounded, column, load, slices, stored, tidy

LONGEST = 4
LEAST = 30
TOP = 2_000
COVERED = 80
NO_LANG = "und"
MIN_BITS, MAX_BITS = 20, 25
#: Words that a task counts together.
RUN = 1_000_000
#: Bytes of text that are cut into words at a time.
WINDOW = 1 << 20
_BLOCK_BITS = 16
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A-Z in lower case, whatever ends a piece as ".", a tab as a blank.
_TABLE = bytes(46 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers, one a place.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_DRAWN = np.random.default_rng(20240711)
#: Two independent polynomial hashes modulo 2**64: values of bytes, and odd bases with their inverses.
_VALUES = _DRAWN.integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[:, [32, 46]] = 0
_BASES = [int(x) | 1 for x in _DRAWN.integers(1 << 62, 1 << 63, 2, np.uint64)]
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _base_powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses, for texts of so many bytes."""
    if not _powers or len(_powers[0][0]) < size:
        row = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]), dtype=np.uint64)
        _powers[:] = [(row(np.uint64(b)), row(np.uint64(pow(b, -1, 1 << 64)))) for b in _BASES]
    return _powers


class _Run:
    """Words of texts in order: where they are, their two hashes, and the piece that each lies in."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.words = self.pieces = 0

    def add(self, texts: list[bytes]) -> None:
        whole = (b".".join(texts) + b".").translate(_TABLE)
        at = 0
        while at < len(whole):
            end = at + WINDOW
            if end < len(whole):  # a window ends where no word does: after a separator
                end = max(whole.rfind(b" ", at, end), whole.rfind(b".", at, end)) + 1
                if end <= at:
                    after = [x for x in (whole.find(b" ", at + WINDOW), whole.find(b".", at + WINDOW)) if x >= 0]
                    end = min(after) + 1
            self._window(whole[at:end])
            at = end

    def _window(self, text: bytes) -> None:
        x = np.frombuffer(text, np.uint8)
        edge = np.diff(np.concatenate([[False], (x != 32) & (x != 46), [False]]).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        pieces = np.cumsum(x == 46)
        if len(starts):
            hashes = []
            for values, (up, down) in zip(_VALUES, _base_powers(len(x)), strict=True):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(values[x] * up[: len(x)], dtype=np.uint64)])
                hashes.append((sums[ends] - sums[starts]) * down[starts])
            self.parts.append((starts + self.size, ends + self.size, *hashes, pieces[starts] + self.pieces))
        self.texts.append(text)
        self.size += len(x)
        self.words += len(starts)
        self.pieces += int(pieces[-1]) if len(pieces) else 0

    def joined(self) -> tuple[bytes, tuple[np.ndarray, ...]]:
        """The text and (starts, ends, hashes, other hashes, pieces) of its words; the run is empty then."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        columns = tuple(np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else none
        text = b"".join(self.texts)
        self.__init__()
        return text, columns


def _phrase_hashes(hashes: np.ndarray, length: int, lang: str) -> np.ndarray:
    """A hash of the phrase of so many words at each place."""
    n = max(0, len(hashes) - length + 1)
    h = np.full(n, xxhash.xxh64_intdigest(lang.encode(), length), np.uint64)
    for k in range(length):
        h += hashes[k : k + n] * _PLACES[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class _Counts:
    """Counts of 2**bits buckets that stop at the threshold, or marks (threshold 1)."""

    def __init__(self, bits: int, least: int) -> None:
        self.kind = np.uint8 if least < 256 else np.uint32
        self.least, self.bits = least, bits
        self.held = np.zeros(1 << bits, self.kind)

    def add(self, buckets: np.ndarray) -> None:
        buckets = buckets[self.held[buckets] < self.least]
        at, n = np.unique(buckets, return_counts=True)
        self.held[at] = np.minimum(self.held[at].astype(np.int64) + n, self.least).astype(self.kind)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        size = 1 << min(_BLOCK_BITS, self.bits)
        for k in range(len(self.held) // size):
            part = self.held[k * size : (k + 1) * size]
            if part.any():
                yield k, part.tobytes()


def _counter(length: int, bits: int, least: int, marks: tuple[np.ndarray, np.ndarray] | None, ahead: bool):
    """Task function of one pass. marks: packed bits of the buckets of this length and of the phrases one word shorter; ahead: count the next length's buckets."""

    def passing(hashes: np.ndarray, own_hashes: np.ndarray, pieces: np.ndarray, lang: str) -> np.ndarray:
        """Places of the phrases of this length that lie within a piece and may reach the threshold."""
        n = len(own_hashes)
        at = np.flatnonzero(pieces[:n] == pieces[length - 1 : length - 1 + n])
        if marks is not None and len(at):
            own, shorter = marks
            b = _bucket(own_hashes[at], bits)
            at = at[((own[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)]
            b = _bucket(_phrase_hashes(hashes, length - 1, lang), bits)
            hit = ((shorter[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
            at = at[hit[at] & hit[at + 1]]
        return at

    def counted(runs: dict[str, _Run], buckets: _Counts | None) -> Iterator[pa.RecordBatch]:
        for lang, run in runs.items():
            text, (starts, ends, hashes, others, pieces) = run.joined()
            if len(starts) < length:
                continue
            own = _phrase_hashes(hashes, length, lang)
            at = passing(hashes, own, pieces, lang)
            if not len(at):
                continue
            if buckets is not None and len(at) > 1:
                both = at[:-1][np.diff(at) == 1]
                both = both[pieces[both] == pieces[np.minimum(both + length, len(pieces) - 1)]]
                both = both[both + length < len(pieces)]
                buckets.add(_bucket(_phrase_hashes(hashes, length + 1, lang)[both], bits))
            # Equal phrases lie together in the order of their hashes; the second hash tells those apart that share the first.
            h = own[at]
            order = np.argsort(h)
            at, h = at[order], h[order]
            o = _phrase_hashes(others, length, lang)[at]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(head, len(at)))
            if (o != np.repeat(o[head], n)).any():
                order = np.lexsort((o, h))
                at, h, o = at[order], h[order], o[order]
                head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
                n = np.diff(np.append(head, len(at)))
            first = at[head]
            a, z = starts[first], ends[first + length - 1]
            spelt = [text[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]
            # Several blanks between words are one.
            letters = sum(ends[first + k] - starts[first + k] for k in range(length))
            for i in np.flatnonzero(z - a != letters + length - 1).tolist():
                spelt[i] = b" ".join(w for w in spelt[i].split(b" ") if w)
            for s in range(0, len(spelt), 200_000):
                part = spelt[s : s + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array(n[s : s + 200_000], pa.int64()), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())],
                    ["lang", "phrase", "n", "block", "counts"],
                )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, _Run] = {}
        buckets = _Counts(bits, least) if ahead else None
        for batch in slices(batches):
            groups: dict[str, list[bytes]] = {}
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    groups.setdefault(lang, []).append(text)
            for lang, texts in groups.items():
                runs.setdefault(lang, _Run()).add(texts)
            if sum(r.words for r in runs.values()) >= RUN:
                yield from counted(runs, buckets)
        yield from counted(runs, buckets)
        if buckets is not None:
            for k, data in buckets.blocks():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["lang", "phrase", "n", "block", "counts"])

    return run


_PASS = "lang string, phrase binary, n long, block int, counts binary"


def _marked(blocks: DataFrame, bits: int, least: int) -> np.ndarray:
    """Packed bits of the buckets whose counts, summed over all tasks' blocks (block, counts), reach `least`. What reaches the driver is 2**bits bits."""
    kind = np.uint8 if least < 256 else np.uint32

    @tidy
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(column(batch, "block").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                part = np.frombuffer(data, kind)
                # Sums stop at the threshold too, so they never leave the type: both sides are `least` at most.
                held[k] = part.copy() if k not in held else np.minimum(held[k].astype(np.uint32) + part, least).astype(kind)
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(part >= least, bitorder="little").tobytes()], pa.binary())], ["block", "marks"])

    out = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    for r in blocks.select("block", "counts").repartition("block").mapInArrow(sums, "block int, marks binary").toLocalIterator():
        part = np.frombuffer(bytes(r.marks), np.uint8)
        out[r.block * len(part) : (r.block + 1) * len(part)] = part
    return out


def _phrase_marks(frequent: DataFrame, length: int, bits: int) -> np.ndarray:
    """Packed bits of the buckets of the phrases (lang, phrase)."""

    @tidy
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts(bits, 1)
        for batch in batches:
            groups: dict[str, _Run] = {}
            for lang, phrase in zip(column(batch, "lang").to_pylist(), column(batch, "phrase").cast(pa.binary()).to_pylist(), strict=True):
                groups.setdefault(lang, _Run()).texts.append(phrase)
            for lang, run in groups.items():
                phrases, run.texts = run.texts, []
                run.add(phrases)
                hashes = run.joined()[1][2]
                held.add(_bucket(_phrase_hashes(hashes, length, lang)[::length], bits))
        for k, data in held.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["block", "counts"])

    return _marked(frequent.select("lang", "phrase").mapInArrow(marks, "block int, counts binary"), bits, 1)


def bits_for(n_bytes: int) -> int:
    """Bits of a bitmap for texts of so many bytes: about a bucket for every 32 words."""
    return min(MAX_BITS, max(MIN_BITS, int(n_bytes // 192).bit_length()))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, f) of each length that reach `least`], (lang, n)): the exact counts of phrases of 1 to `longest` words and of all words."""
    rows = bounded(docs).select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    if bits is None:
        bits = bits_for(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    found: list[DataFrame] = []
    marks, totals = None, None
    for length in range(1, longest + 1):
        got = stored(rows.mapInArrow(_counter(length, bits, least, marks, length < longest), _PASS))
        phrases = got.where("phrase is not null")
        counts = phrases.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))
        found.append(stored(counts.where(F.col("f") >= least)))
        if length == 1:
            totals = phrases.groupBy("lang").agg(F.sum("n").alias("n"))
        if length < longest:
            marks = (_marked(got.where("block is not null"), bits, least), _phrase_marks(found[-1], length, bits))
    return found, totals


def _part(start: int, length: int) -> Column:
    """Words start .. start + length - 1 of the phrase, from the array w."""
    return F.array_join(F.slice("w", start + 1, length), " ")


def scored(found: list[DataFrame], totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words or more: l and r are those of the cut with the lowest score."""
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    parts = every.select(F.col("lang").alias("pl"), F.col("phrase").alias("whole"), F.col("f").alias("pf"))
    cuts = None
    for length, df in enumerate(found[1:], 2):
        own = df.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
        sides = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), (_part(0, k) if side == 0 else _part(k, length - k)).alias("part")) for k in range(1, length) for side in (0, 1)])
        some = own.select("lang", "phrase", "a", F.inline(sides))
        cuts = some if cuts is None else cuts.unionByName(some)
    met = cuts.join(parts, (F.col("lang") == F.col("pl")) & (F.col("part") == F.col("whole")))
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("pf"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("pf"))).alias("r"))
    value = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("b"))
    return best.join(totals, "lang").select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def uncovered(candidates: DataFrame, found: list[DataFrame], covered: int = COVERED) -> DataFrame:
    """The candidates that no longer phrase covers: none holds their words in a row with at least `covered` percent of their count."""
    inner = None
    for length, df in enumerate(found[2:], 3):
        own = df.select("lang", F.col("f"), F.split("phrase", " ").alias("w"))
        some = own.select("lang", F.explode(F.array(*[_part(s, n) for n in range(2, length) for s in range(length - n + 1)])).alias("phrase"), "f")
        inner = some if inner is None else inner.unionByName(some)
    if inner is None:
        return candidates
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * by
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (wide("most", 100) < wide("a", covered))).drop("most")


def top(candidates: DataFrame, limit: int = TOP) -> DataFrame:
    """The first `limit` of each language by score, count and phrase, with their rank. Parts of a language are cut to so many rows before they meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    dealt = candidates.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= limit)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= limit).drop("deal")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, limit: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words (four at most).

    A null text is empty; a null language is `und`, together with rows that say so. Documents never share a phrase. Repeated rows count each time; ties end with
    the phrase's bytes. No candidates, or an empty table: no rows. Other columns are ignored, whatever their names. A word of any length is a word.
    """
    found, totals = frequent_phrases(docs, text_col, lang_col, least, longest, bits)
    out = top(uncovered(scored(found, totals), found, covered), limit)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of the documents."""
    return collocations(load(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(t, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents)
), f AS MATERIALIZED (
  SELECT lang, len(p) AS m, array_to_string(p, ' ') AS phrase, p, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda s: w[s : s + k - 1])) AS p FROM pieces, range(1, 5) t(k) WHERE len(w) >= k)
  GROUP BY lang, p
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 : c.m]
), best AS (
  SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts) WHERE o = 1
), inside AS (
  SELECT lang, q, max(f) AS most FROM (SELECT lang, f, p[s : s + z - 1] AS q FROM (SELECT *, unnest(range(2, m)) AS z FROM c WHERE m > 2), range(1, 4) t(s) WHERE s + z - 1 <= m) GROUP BY lang, q
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND array_to_string(inside.q, ' ') = best.phrase WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT kept.*, n.n, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept JOIN n USING (lang)) WHERE rank <= 2000
"""
