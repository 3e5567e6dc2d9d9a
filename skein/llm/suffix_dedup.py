"""Exact removal of repeated substrings by blockwise suffix sorting with a difference cover.

Every byte that lies in a `length`-byte string (200) that starts anywhere else too is removed. The suffixes that have to be
sorted are cut down first, without loss:

1. Buckets. The smallest hash of the GRAM-byte strings in a window (the leftmost of equal ones) is the window's anchor. It depends on the window's bytes
   alone, so equal windows have equal anchors at equal offsets: the anchor's hash is the suffix bucket of a window, and
   the windows of consecutive starts that share one anchor are a run. Anchors whose bucket holds one run are done.
2. Identical runs. A run's context is the bytes its windows cover. In a bucket, contexts that are equal (64-bit hash of the
   whole context beside the anchor's own) are collapsed before anything is sorted: each window of such a run repeats.
3. Blocks. One context for each distinct one in the remaining buckets is fetched and a task sorts its windows a block of buckets
   at a time: difference-cover sample ranks are computed first, then one range of suffixes after the other is sorted by its first `period` bytes
   and longer ties are settled by the ranks of the cover positions, so memory is bounded by the block. Neighbours in that order
   that agree in `length` bytes repeat.

Buckets are split over tasks by an equi-join whose hot keys Spark can split, and counted with partial aggregation
before they are shuffled. A bucket with over BIG_BUCKET distinct contexts is not given to one task: its windows are told apart by more bytes around the
anchor (those that all windows at a range of offsets share), which makes smaller buckets that take steps 2 and 3 in turn; the
ranges get narrower (SPLITS) until no bucket is too large.

Texts are anchored in pieces of PIECE bytes that overlap by a window, so a text's length does not bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, column, load, slices, stored, tidy

LENGTH = 200
GRAM = 40
BIG_BUCKET = 10_000
#: Offsets of a window's start before its anchor that share a smaller bucket, by round; at the last one a bucket is one window's bytes.
SPLITS = (81, 21, 5, 1)
#: Bytes of a text that are anchored at a time.
PIECE = 2 << 20
#: Bytes of contexts that a block holds, and suffixes that are sorted at a time.
BLOCK_BYTES = 1 << 20
BLOCK_SUFFIXES = 1 << 17
_SLICE = 1 << 20
_POSITION_BITS = 30
_U = np.uint64


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as they were asked for."""

    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                full = np.full(size, base, _U)
                full[0] = 1
                setattr(self, name, np.cumprod(full, dtype=_U))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


class Anchors:
    """The runs of a list of texts: text number, anchor p, first and last window start a, b (in the text), hashes."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM, piece: int = PIECE):
        self.length, self.gram = length, gram
        # Window starts are dealt to the pieces, so neighbouring pieces share length - 1 bytes.
        pieces = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t) - length + 1, piece)]
        found: list[tuple[np.ndarray, ...]] = []
        group: list[tuple[int, int]] = []
        held = 0
        for i, at in pieces:
            group.append((i, at))
            held += min(piece, len(texts[i]) - at)
            if held >= piece:
                found.append(self._runs(texts, group, piece))
                group, held = [], 0
        if group:
            found.append(self._runs(texts, group, piece))
        empty = np.zeros(0, np.int64)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [empty] * 4 + [empty.view(_U)] * 2
        self.text, self.p, self.a, self.b, self.anchor, self.context = columns

    def _runs(self, texts: list[bytes], group: list[tuple[int, int]], piece: int) -> tuple[np.ndarray, ...]:
        """The runs of some pieces (text, place)."""
        length, gram = self.length, self.gram
        parts = [texts[i][at : at + piece + length - 1] for i, at in group]
        number, place = (np.array(c, np.int64) for c in zip(*group, strict=True))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        x = np.frombuffer(b"".join(parts), np.uint8)
        n = len(x)
        starts = np.cumsum(sizes) - sizes
        up, down = _POWERS.to(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[x] * up[:n], out=sums[1:])
        h = _mix((sums[gram:] - sums[:-gram]) * down[: n + 1 - gram])
        low = (h >> _U(_POSITION_BITS) << _U(_POSITION_BITS)) | np.arange(len(h), dtype=_U)
        span, have = length - gram + 1, 1
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if span > have:
            low = np.minimum(low[: have - span], low[span - have :])
        pos = (low & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)  # of each window start, those across pieces too
        ends = np.repeat(starts + sizes - length, sizes)[: len(pos)]
        valid = np.arange(len(pos)) <= ends
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (pos[1:] != pos[:-1])
        last = valid.copy()
        last[:-1] &= first[1:] | ~valid[1:]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        p = pos[a]
        where = np.searchsorted(starts, a, "right") - 1
        at = starts[where] - place[where]
        shape = ((p - a).astype(_U) << _U(32)) | (b - a).astype(_U)
        return number[where], p - at, a - at, b - at, h[p], _mix((sums[b + length] - sums[a]) * down[a] + _mix(shape))


def cover(period: int) -> np.ndarray:
    """A difference cover: for any i, j some shift below `period` takes both to residues in it."""
    s = int(np.ceil(np.sqrt(period)))
    return np.unique(np.concatenate([np.arange(s), np.arange(s - 1, period, s), [period - 1]]))


class CoverSorter:
    """Sorts suffixes of a text of bounded size by their first `length` bytes or more.

    ranks: of the positions whose residue is in the cover, by their first `length` bytes.
    """

    def __init__(self, data: bytes, length: int = LENGTH, period: int = 64):
        period = min(period, length)
        self.length, self.period, self.n = length, period, len(data)
        padded = np.frombuffer(data + bytes(2 * length + period + 16), np.uint8)
        self.words = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
        self.cover = cover(period)
        inside = np.zeros(period, bool)
        inside[self.cover] = True
        # shift[r]: how far a position of residue r is from its next cover position
        both = np.concatenate([inside, inside])
        self.shift = np.array([int(np.argmax(both[r:])) for r in range(period)])
        self.inside = inside
        sample = np.flatnonzero(inside[np.arange(self.n + period) % period])
        pos, group = self._refine(sample, np.zeros(len(sample), np.int64), 0, period)
        self.ranks = np.zeros(self.n + length + 4 * period, np.int32)
        self.ranks[pos] = group
        # A cover position plus the period is one again, so the ranks of `reach` bytes give those of twice as many.
        reach = period
        while reach < length:
            pos, group = self._split(pos, group, self.ranks[pos + reach])
            self.ranks[pos] = group
            reach *= 2

    def _refine(self, pos: np.ndarray, group: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """pos in order, and the number of each one's class, after comparing bytes begin to end; only ties are read on."""
        pos, group = pos.copy(), group.copy()
        live = np.arange(len(pos))
        for d in range(begin, end, 8):
            if not len(live):
                break
            key = self.words[np.minimum(pos[live] + d, len(self.words) - 1)].astype(_U)
            if d + 8 > end:
                key &= ~_U((1 << (8 * (d + 8 - end))) - 1)
            live = live[self._order(pos, group, live, key)]
        return pos, group

    @staticmethod
    def _order(pos: np.ndarray, group: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Orders the places `live` by class and key, in place; which of them are still tied."""
        order = np.lexsort((key, group[live]))
        key, old = key[order], group[live][order]
        pos[live] = pos[live][order]
        new = np.ones(len(live), bool)
        new[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        # a class is numbered by its first place in the whole order
        heads = np.flatnonzero(new)
        group[live] = live[np.repeat(heads, np.diff(np.append(heads, len(live))))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        return tied

    def _split(self, pos: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes in order, split by another key."""
        pos, group = pos.copy(), group.copy()
        same = group[1:] == group[:-1]
        tied = np.zeros(len(pos), bool)
        tied[1:] |= same
        tied[:-1] |= same
        live = np.flatnonzero(tied)
        if len(live):
            self._order(pos, group, live, key[live])
        return pos, group

    def _compare(self, i: int, j: int) -> int:
        """Order of two suffixes that agree in their first `period` bytes, by the ranks at a shift common to both."""
        r, s = i % self.period, j % self.period
        for d in range(self.period):
            if self.inside[(r + d) % self.period] and self.inside[(s + d) % self.period]:
                return int(self.ranks[i + d] > self.ranks[j + d]) - int(self.ranks[i + d] < self.ranks[j + d])
        raise AssertionError("not a difference cover")

    def blocks(self, starts: np.ndarray, aligned: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One range of suffixes after the other: (positions in order, class of the first `period` bytes).

        aligned: strings that agree are known to start at equal residues, so classes are ordered residue by residue.
        """
        words = self.words[starts].astype(_U)
        parts = -(-len(starts) // BLOCK_SUFFIXES)
        if parts > 1:
            probe = np.sort(words[:: max(1, len(words) // (64 * parts))])
            edges = np.unique(probe[np.linspace(0, len(probe) - 1, parts + 1).astype(int)[1:-1]])
            bucket = np.searchsorted(edges, words, "right")
        else:
            bucket = np.zeros(len(starts), np.int64)
        for k in range(int(bucket.max(initial=-1)) + 1):
            mine = starts[bucket == k]
            if not len(mine):
                continue
            pos, group = self._refine(mine, np.zeros(len(mine), np.int64), 0, self.period)
            residue = pos % self.period
            rank = self.ranks[pos + self.shift[residue]]
            order = np.lexsort((rank, residue, group))
            pos = pos[order]
            if not aligned:
                pos = self._merge(pos, group)
            yield pos, group

    def _merge(self, pos: np.ndarray, group: np.ndarray) -> np.ndarray:
        from functools import cmp_to_key

        heads = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(pos))
        for x, y in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            if y - x > 1 and len(np.unique(pos[x:y] % self.period)) > 1:
                pos[x:y] = sorted(pos[x:y].tolist(), key=cmp_to_key(self._compare))
        return pos

    def repeated(self, starts: np.ndarray, aligned: bool = False) -> np.ndarray:
        """Those of the starts whose first `length` bytes start at another one of them too, sorted."""
        out = []
        for pos, group in self.blocks(starts, aligned):
            near = np.flatnonzero(group[1:] == group[:-1])
            for d in range(0, self.length, 8):
                if not len(near):
                    break
                x, y = self.words[pos[near] + d].astype(_U), self.words[pos[near + 1] + d].astype(_U)
                if d + 8 > self.length:
                    x, y = x >> _U(8 * (d + 8 - self.length)), y >> _U(8 * (d + 8 - self.length))
                near = near[x == y]
            out += [pos[near], pos[near + 1]]
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


@tidy
def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, ch, c): runs by anchor and context, counted within each slice so that copies leave the task as one row."""
    for batch in slices(batches, limit=_SLICE):
        runs = Anchors(_binary(batch, "text"))
        if len(runs.a):
            order = np.lexsort((runs.context, runs.anchor))
            x, y = runs.anchor[order], runs.context[order]
            heads = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            yield pa.RecordBatch.from_arrays([_signed(x[heads]), _signed(y[heads]), pa.array(np.diff(np.append(heads, len(x))))], ["ah", "ch", "c"])


@tidy
def _place_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, ah, ch, p, a, b): the runs with their places."""
    for batch in slices(batches, limit=_SLICE):
        runs = Anchors(_binary(batch, "text"))
        if len(runs.a):
            at = pa.array(runs.text)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "k1").take(at), column(batch, "k2").take(at), _signed(runs.anchor), _signed(runs.context), *(pa.array(x.astype(np.int32)) for x in (runs.p, runs.a, runs.b))],
                ["k1", "k2", "ah", "ch", "p", "a", "b"],
            )


_CONTEXT = "ah long, c long, k1 long, k2 long, p int, a int, b int, bytes binary"


@tidy
def _fetch_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts wanted of each text; rows that repeat in a task give theirs once."""
    names = ["ah", "c", "k1", "k2", "p", "a", "b", "bytes"]
    seen: set[tuple] = set()
    for batch in slices(batches):
        rows: list[tuple] = []
        texts, k1, k2 = (column(batch, n) for n in ("text", "k1", "k2"))
        for text, x, y, wanted in zip(texts.to_pylist(), k1.to_pylist(), k2.to_pylist(), column(batch, "wanted").to_pylist(), strict=True):
            if (x, y) in seen:
                continue
            if len(seen) >= 1 << 16:  # a context told twice by one row changes nothing
                seen.clear()
            seen.add((x, y))
            data = text.encode() if isinstance(text, str) else (text or b"")
            rows += [(w["ah"], w["c"], x, y, w["p"], w["a"], w["b"], data[w["a"] : w["b"] + LENGTH]) for w in wanted]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def sort_contexts(rows: list[tuple], period: int = 64) -> list[tuple[int, int, int, int]]:
    """(k1, k2, a, b): for contexts (ah, c, k1, k2, p, a, b, bytes) of whole buckets, the runs of windows that repeat in another.

    Only contexts that were met once (c = 1) are told about; the others repeat as a whole.
    """
    parts, starts, base = [], [], 0
    for _, _, _, _, p, a, b, data in rows:
        lead = -(base + p - a) % period  # anchors come to equal residues
        parts += [bytes(lead), data]
        base += lead
        starts.append(base)
        base += len(data)
    sorter = CoverSorter(b"".join(parts), LENGTH, period)
    counts = np.array([b - a + 1 for _, _, _, _, _, a, b, _ in rows])
    first = np.cumsum(counts) - counts
    windows = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(np.array(starts), counts)
    hit = np.isin(windows, sorter.repeated(windows, aligned=True), assume_unique=True)
    out = []
    once = np.repeat(np.array([r[1] == 1 for r in rows]), counts)
    hit &= once
    owner = np.repeat(np.arange(len(rows)), counts)
    flags = np.flatnonzero(hit)
    if len(flags):
        breaks = np.flatnonzero((np.diff(flags) != 1) | (np.diff(owner[flags]) != 0))
        for x, y in zip(np.append(0, breaks + 1).tolist(), np.append(breaks, len(flags) - 1).tolist(), strict=True):
            i = int(owner[flags[x]])
            _, _, k1, k2, _, a, _, _ = rows[i]
            out.append((k1, k2, a + int(flags[x] - first[i]), a + int(flags[y] - first[i])))
    return out


@tidy
def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in order of their buckets, a block of whole buckets at a time."""
    held: list[tuple] = []
    size = 0

    def done(rows: list[tuple]) -> pa.RecordBatch:
        found = sort_contexts(rows)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        cols = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["k1", "k2", "a", "b"])

    for batch in batches:
        for row in zip(*(column(batch, n).to_pylist() for n in ("ah", "c", "k1", "k2", "p", "a", "b", "bytes")), strict=True):
            if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
    if held:
        yield done(held)


def narrowed(width: int):
    """Contexts cut into those of at most `width` neighbouring offsets, in buckets by the bytes that all windows at these offsets share."""
    names = ["ah", "ch", "c", "k1", "k2", "p", "a", "b", "bytes"]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 18):
            rows: list[tuple] = []
            for ah, c, k1, k2, p, a, b, data in zip(*(column(batch, n).to_pylist() for n in ("ah", "c", "k1", "k2", "p", "a", "b", "bytes")), strict=True):
                for group in range((p - b) // width, (p - a) // width + 1):
                    low, high = p - group * width, p - (group + 1) * width + 1  # window starts, the latest and the earliest
                    first, last = max(a, high), min(b, low)
                    piece = data[first - a : last + LENGTH - a]
                    key = xxhash.xxh64_intdigest(data[low - a : high + LENGTH - a], (ah ^ group) & _MASK)
                    own = xxhash.xxh64_intdigest(piece, (p - first) << 32 | last - first)
                    rows.append((_as_long(key), _as_long(own), c, k1, k2, p, first, last, piece))
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


_MASK = (1 << 64) - 1


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _crowded(distinct: DataFrame, big_bucket: int) -> DataFrame:
    return distinct.groupBy("ah").agg(F.count("*").alias("m")).where(F.col("m") > big_bucket).select("ah")


def _sorted_windows(contexts: DataFrame) -> DataFrame:
    return contexts.repartition("ah").sortWithinPartitions("ah").mapInArrow(_sort_blocks, "k1 long, k2 long, a int, b int")


def _windows_of_crowded(contexts: DataFrame, big_bucket: int) -> Iterator[DataFrame]:
    """(k1, k2, a, b) for contexts in buckets too large for a task: split further, round by round, and each round's other buckets sorted."""
    for width in SPLITS:
        split = stored(contexts.mapInArrow(narrowed(width), "ah long, ch long, c long, k1 long, k2 long, p int, a int, b int, bytes binary"))
        distinct = stored(split.groupBy("ah", "ch").agg(F.sum("c").alias("c"), F.min(F.struct("k1", "k2", "p", "a", "b", "bytes")).alias("at")).select("ah", "ch", "c", "at.*"))
        yield split.where("c = 1").join(distinct.where("c > 1").select("ah", "ch"), ["ah", "ch"], "left_semi").select("k1", "k2", "a", "b")
        crowded = _crowded(distinct, big_bucket)
        yield _sorted_windows(distinct.drop("ch").join(crowded, "ah", "left_anti"))
        contexts = distinct.drop("ch").join(crowded, "ah", "left_semi")
        if crowded.isEmpty():
            return


def repeated_windows(keyed: DataFrame, big_bucket: int = BIG_BUCKET) -> DataFrame:
    """(k1, k2, a, b): ranges of window starts that repeat, for rows (k1, k2, text, ...); ranges may touch or overlap."""
    # A table of its own, so that the join below reads two plain exchanges and Spark can split a hot anchor.
    stats = stored(
        keyed.select("text").mapInArrow(_count_runs, "ah long, ch long, c long").groupBy("ah")
        .agg(F.sum("c").alias("n"), F.min("ch").alias("lo"), F.max("ch").alias("hi")).where("n > 1").select("ah", (F.col("lo") != F.col("hi")).alias("mixed"))
    )
    placed = keyed.select("k1", "k2", "text").mapInArrow(_place_runs, "k1 long, k2 long, ah long, ch long, p int, a int, b int")
    # Dealt by text again, so that a hot anchor's rows come from all tasks below and Spark can split them there too.
    runs = stored(placed.join(stats, "ah").repartition("k1", "k2"))
    mixed = runs.where("mixed").drop("mixed")
    distinct = stored(mixed.groupBy("ah", "ch").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "p", "a", "b")).alias("at")))
    several = mixed.join(distinct.where("c > 1").select("ah", "ch"), ["ah", "ch"], "left_semi")
    wanted = distinct.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
        F.collect_list(F.struct("ah", "c", F.col("at.p").alias("p"), F.col("at.a").alias("a"), F.col("at.b").alias("b"))).alias("wanted")  # at most a text's runs
    )
    contexts = keyed.join(wanted, ["k1", "k2"]).mapInArrow(_fetch_contexts, _CONTEXT)
    crowded = stored(_crowded(distinct, big_bucket))
    found = [runs.where("not mixed").select("k1", "k2", "a", "b"), several.select("k1", "k2", "a", "b")]
    if crowded.isEmpty():
        found.append(_sorted_windows(contexts))
    else:
        found += [_sorted_windows(contexts.join(crowded, "ah", "left_anti")), *_windows_of_crowded(contexts.join(crowded, "ah", "left_semi"), big_bucket)]
    return reduce(DataFrame.unionByName, found)


def cut_ranges(data: bytes, ranges: list[int] | None, length: int = LENGTH) -> tuple[bytes, int, int]:
    """What is left of a text without its repeated windows, the bytes removed and their maximal runs. ranges: first << 32 | last start."""
    if not ranges:
        return data, 0, 0
    packed = np.sort(np.array(ranges, np.int64))
    first, end = packed >> 32, np.maximum.accumulate((packed & 0xFFFFFFFF) + length)
    heads = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))  # ranges that touch are one run
    begins, stops = first[heads], end[np.append(heads[1:], len(end)) - 1]
    view = memoryview(data)
    kept = b"".join([view[x:y] for x, y in zip([0, *stops.tolist()], [*begins.tolist(), len(data)], strict=True)])
    return kept, int((stops - begins).sum()), len(begins)


def _cutter(as_text: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = _binary(batch, "text")
            kept, removed, spans = zip(*(cut_ranges(t, r) for t, r in zip(texts, column(batch, "ranges").to_pylist(), strict=True)), strict=True)
            held = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            sizes = (pa.array(x, pa.int64()) for x in ([len(t) for t in texts], removed, spans))
            yield pa.RecordBatch.from_arrays([column(batch, "row"), held, *sizes], ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", big_bucket: int = BIG_BUCKET, as_text: bool = False) -> DataFrame:
    """docs' other columns packed in `row`, with kept (binary), n_bytes, n_removed and n_spans for each row.

    as_text: kept is a string, without the bytes of characters that a cut leaves in part.

    A null text is empty; texts below 200 bytes lose nothing; repeated rows (even of one id) repeat each other
    and so lose all they have if it is 200 bytes or more; an empty table gives no rows. Rows are told apart by id and a hash of the text.
    """
    keyed = bounded(docs).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"),
        F.xxhash64(text_col).alias("k2"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
    )
    ranges = repeated_windows(keyed, big_bucket).groupBy("k1", "k2").agg(F.collect_set((F.col("a").cast("long") * (1 << 32)) + F.col("b")).alias("ranges"))  # a text's runs, however often its row repeats
    joined = keyed.join(ranges, ["k1", "k2"], "left")
    schema = joined.select("row").schema
    for name, kind in (("kept", "string" if as_text else "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(_cutter(as_text), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's length, removed bytes and runs, and the digest of what is left."""
    out = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of their texts; a character that a cut leaves in part goes whole."""
    out = remove_repeats(docs, id_col, text_col, as_text=True)
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
