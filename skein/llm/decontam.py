"""Benchmark decontamination by q-gram lemma filtering.

A string within e edits of an item of m characters shares at least m + 1 - q (e + 1) of the item's q-grams with it, all
on diagonals (place in the text minus place in the item) at most e apart. One pass over whole texts
looks every q-gram up in the items' table, counts the shared ones by item and diagonal band (bands of e + 1, each taken with its
neighbour, so they overlap), keeps the bands that reach the bound and verifies those regions by a banded
alignment of the whole item. Characters are code points; A-Z is lower-cased and white space counts as a blank.

The items are the side that is sent to every task. Their size is read first: beyond BLOCK_CHARS they are dealt into blocks of bounded size
and each block is its own pass over the texts. No document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, column, load, slices, texts_of, tidy

Q = 8
#: Edits allowed, as a share of an item's characters.
EDITS = 0.1
BLOCK_CHARS = 4 << 20
_TABLE_BITS = 22
_PAIRS = 1 << 21
#: Characters that are looked up at a time, and places from which a run of one gram is counted as a whole.
_PLACES = 1 << 20
_RUN = 64
#: Diagonals of a piece of a wide region, and cells of a row that regions of like width make together.
_WIDE = 1 << 16
_CELLS = 1 << 18
_SEPARATOR = 0x110000
_NONE = 0x110001


def codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    x[(x >= 65) & (x <= 90)] += 32
    x[(x >= 9) & (x <= 13)] = 32
    return x


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the Q = 8 characters from each place on."""
    if len(x) < Q:
        return np.zeros(0, np.uint32)
    h = x * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    for step, k in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F)):
        h = h[:-step] * np.uint32(k) + (h[step:] ^ (h[step:] >> np.uint32(13)))
    return h ^ (h >> np.uint32(16))


@dataclass
class ItemIndex:
    """Postings of the items' q-grams. An item's edit budget shrinks where the bound would fall below one shared q-gram."""

    ids: list[int]
    texts: list[str]
    items: list[np.ndarray] = field(init=False)
    budget: np.ndarray = field(init=False)
    need: np.ndarray = field(init=False)
    sizes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.items = [codes(t) for t in self.texts]
        m = self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.budget = np.maximum(0, np.minimum((m * EDITS).astype(np.int64), m // Q - 1))
        self.need = m + 1 - Q * (self.budget + 1)
        hashes = [gram_hashes(x) for x in self.items]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else owner
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.grams >> np.uint32(32 - _TABLE_BITS)] = True
        #: Items with fewer than Q characters have no q-gram: the rare case is a plain containment test.
        self.short = [(i, "".join(map(chr, x.tolist()))) for i, x in enumerate(self.items) if 0 < len(x) < Q]

    def _base(self, item: np.ndarray | int, starts: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The number of the band in which diagonal 0 of a text lies. Bands of different texts are neither shared nor neighbours, for any item."""
        width = self.budget[item] + 1
        return (starts[text] + text * (self.sizes[item] + 4 * width)) // width

    def _hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h whose gram an item has, and the gram's number."""
        at = np.flatnonzero(self.table[h >> np.uint32(32 - _TABLE_BITS)])
        g = np.searchsorted(self.grams, h[at])
        g[g == len(self.grams)] = 0
        real = self.grams[g] == h[at]
        return at[real], g[real]

    def _cells(self, local: np.ndarray, text: np.ndarray, g: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item << 40 | band, shared grams) of single places, sorted, in parts of bounded size."""
        count = self.count[g]
        total = np.cumsum(count)
        begin = 0
        while begin < len(g):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + _PAIRS, "right")))
            n = count[begin:end]
            post = np.repeat(self.first[g[begin:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owner = self.owner[post]
            diagonal = np.repeat(local[begin:end], n) - self.place[post]
            # Bands start below zero: an item's start may lie before the text's.
            band = diagonal // (self.budget[owner] + 1) + self._base(owner, starts, np.repeat(text[begin:end], n))
            key = (owner.astype(np.int64) << 40) + band + (1 << 32)
            key.sort()
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield key[head], np.diff(np.append(head, len(key)))
            begin = end

    def _run_cells(self, runs: np.ndarray, item: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of one item from runs (place, text, gram, length) of one gram each: a run and a posting add one to each diagonal of an interval."""
        width = int(self.budget[item]) + 1
        first, last, inner = [], [], []
        for g in np.unique(runs[:, 2]).tolist():
            post = np.arange(self.first[g], self.first[g] + self.count[g])
            place = self.place[post[self.owner[post] == item]].astype(np.int64)
            some = runs[runs[:, 2] == g]
            for p in place.tolist():
                low = some[:, 0] - p
                high = low + some[:, 3] - 1
                base = self._base(item, starts, some[:, 1])
                a, z = low // width, high // width
                same = a == z
                first.append(np.stack([a + base, np.where(same, high - low + 1, (a + 1) * width - low)]))
                last.append(np.stack([z + base, np.where(same, 0, high - z * width + 1)]))
                inner.append(np.stack([a + base + 1, np.maximum(z + base, a + base + 1)]))
        ends, spans = np.concatenate([*first, *last], axis=1), np.concatenate(inner, axis=1)
        least = int(min(ends[0].min(), spans[0].min()))
        size = int(max(ends[0].max(), spans[1].max())) - least + 1
        held = np.zeros(size + 1, np.int64)
        np.add.at(held, spans[0] - least, width)
        np.add.at(held, spans[1] - least, -width)
        held = np.cumsum(held)[:size]
        np.add.at(held, ends[0] - least, ends[1])
        at = np.flatnonzero(held)
        return (item << 40) + at + least + (1 << 32), held[at]

    def _good(self, key: np.ndarray, shared: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Regions from whole cells in order of their keys."""
        item = key >> 40
        both = shared.copy()
        both[:-1] += np.where(key[1:] == key[:-1] + 1, shared[1:], 0)
        good = np.flatnonzero(both >= self.need[item])
        if not len(good):
            return []
        key, item = key[good], item[good]
        width = self.budget[item] + 1
        band = (key & ((1 << 40) - 1)) - (1 << 32)
        text = np.zeros(len(key), np.int64)
        for i in np.unique(item).tolist():
            own = item == i
            bases = self._base(i, starts, np.arange(len(starts)))
            text[own] = np.searchsorted(bases - -(-self.sizes[i] // (self.budget[i] + 1)), band[own], "right") - 1
        local = band - self._base(item, starts, text)
        # A band reaches over its neighbour, so bands two apart still touch.
        fresh = np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (local[1:] > local[:-1] + 2)])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(key)) - 1
        return list(zip(text[head].tolist(), item[head].tolist(), (local[head] * width[head]).tolist(), (local[tail] * width[tail] + 2 * width[tail] - 1).tolist(), strict=True))

    def regions(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item, lowest diagonal, highest diagonal) of bands that reach the bound; bands of a text that touch are one.

        Texts are looked up side by side, _PLACES characters at a time, but diagonals are those of each text: its regions are the same whatever texts are beside
        it. A run of one gram (of one character, then) is counted as a whole, an item at a time, however long it is.
        """
        sizes = np.array([len(x) for x in texts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        gap = np.array([_SEPARATOR], np.uint32)
        every = np.concatenate([y for x in texts for y in (x, gap)]) if texts else np.zeros(0, np.uint32)
        cells: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        runs: list[np.ndarray] = []
        for s in range(0, len(every), _PLACES):
            at, g = self._hits(gram_hashes(every[s : s + _PLACES + Q - 1]))
            at = at + s
            text = np.searchsorted(starts, at, "right") - 1
            local = at - starts[text]
            real = local + Q <= sizes[text]
            at, g, text, local = at[real], g[real], text[real], local[real]
            if not len(g):
                continue
            head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])]))
            length = np.diff(np.append(head, len(g)))
            long = length >= _RUN
            if long.any():
                runs.append(np.stack([local[head[long]], text[head[long]], g[head[long]], length[long]], axis=1))
                single = ~np.repeat(long, length)
                local, text, g = local[single], text[single], g[single]
            for key, n in self._cells(local, text, g, starts):
                cells.append(key)
                sums.append(n)
        none = np.zeros(0, np.int64)
        key, place = np.unique(np.concatenate(cells), return_inverse=True) if cells else (none, none)
        shared = np.bincount(place, np.concatenate(sums)).astype(np.int64) if cells else none
        if not runs:
            return self._good(key, shared, starts)
        every_run = np.concatenate(runs)
        hot = sorted({int(i) for g in np.unique(every_run[:, 2]).tolist() for i in self.owner[self.first[g] : self.first[g] + self.count[g]]})
        cold = ~np.isin(key >> 40, hot)
        out = self._good(key[cold], shared[cold], starts)
        for i in hot:
            a, b = np.searchsorted(key, [i << 40, (i + 1) << 40])
            more, n = self._run_cells(every_run[self._has(every_run[:, 2], i)], i, starts)
            own, place = np.unique(np.concatenate([key[a:b], more]), return_inverse=True)
            out += self._good(own, np.bincount(place, np.concatenate([shared[a:b], n])).astype(np.int64), starts)
        return out

    def _has(self, grams: np.ndarray, item: int) -> np.ndarray:
        """Whether the item has each of the grams."""
        distinct, place = np.unique(grams, return_inverse=True)
        return np.array([bool((self.owner[self.first[g] : self.first[g] + self.count[g]] == item).any()) for g in distinct.tolist()], bool)[place]


def banded_distances(x: np.ndarray, items: list[np.ndarray], low: list[int], high: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each item the least edits that turn it into a piece of x on diagonals low to high, and the piece's end.

    All items advance together, a row of their bands at a time, as wide as the widest. A start anywhere is free.
    """
    m = np.array([len(i) for i in items])
    rows, width = int(m.max()), int(max(b - a for a, b in zip(low, high, strict=True))) + 1
    grid = np.full((len(items), rows), -2, np.int64)
    for r, i in enumerate(items):
        grid[r, : len(i)] = i
    offset = np.minimum(np.array(low, np.int64), len(x))
    # The part of x that the bands reach, with room on both sides: characters there equal none.
    start, stop = int(offset.min()), int(offset.max()) + rows + width
    inside = x[max(0, start) : max(0, min(len(x), stop))]
    if stop - start <= 4 * len(items) * (rows + width):
        text = np.full(stop - start, -1, np.int64)
        text[max(0, -start) : max(0, -start) + len(inside)] = inside
        taken = lambda cols: text[cols - start]
    else:
        held = np.concatenate([x, np.array([_NONE], x.dtype)])
        taken = lambda cols: held[np.where((cols < 0) | (cols >= len(x)), len(x), cols)].astype(np.int64)
    ramp = np.arange(width, dtype=np.int32)
    limit = np.array([b - a for a, b in zip(low, high, strict=True)])
    far = np.int32(1 << 20)
    outside = ramp[None, :] > limit[:, None]
    d = np.where(outside, far, np.int32(0)).astype(np.int32)
    best, where = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i in range(rows):
        new = d + (taken(offset[:, None] + i + ramp[None, :]) != grid[:, i, None])
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        new[outside] = far
        d = np.minimum.accumulate(new - ramp, axis=1) + ramp
        d[outside] = far
        for r in np.flatnonzero(m == i + 1).tolist():
            k = int(np.argmin(d[r]))
            best[r], where[r] = d[r, k], offset[r] + k + m[r]
    return best, where


def aligned(x: np.ndarray, items: list[np.ndarray], low: list[int], high: list[int], slack: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """banded_distances of any regions, in calls of bounded size; distances over an item's slack may be told as any that are.

    Regions of like width go together. A wide region is cut into pieces that overlap by the slack: an alignment of so many edits lies on that many diagonals
    and one, so it is whole in one of them. Its pieces end where one has no edit, since of equal alignments the first counts.
    """
    best, where = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda r: (high[r] - low[r], len(items[r])))
    group: list[int] = []
    for r in order:
        width = high[r] - low[r] + 1
        if width > _WIDE:
            found = None
            step = max(_WIDE - slack[r], 1)
            for a in range(low[r], high[r] + 1, step):
                (d,), (end,) = banded_distances(x, [items[r]], [a], [min(high[r], a + _WIDE - 1 + slack[r])])
                if found is None or d < found[0]:
                    found = (int(d), int(end))
                if not found[0]:
                    break
            best[r], where[r] = found
            continue
        if group and ((len(group) + 1) * width * max(1, len(items[r]) // 64) > _CELLS or width > 2 * (high[group[0]] - low[group[0]] + 1) + 16):
            best[group], where[group] = banded_distances(x, *([y[k] for k in group] for y in (items, low, high)))
            group = []
        group.append(r)
    if group:
        best[group], where[group] = banded_distances(x, *([y[k] for k in group] for y in (items, low, high)))
    return best, where


def find(index: ItemIndex, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every region of the texts within an item's budget, starts and ends in code points."""
    xs = [codes(t) for t in texts]
    wanted: dict[int, list[tuple[int, int, int]]] = {}
    for t, i, low, high in index.regions(xs):
        wanted.setdefault(t, []).append((i, low, min(high, len(xs[t]) + 1)))
    out = []
    for t, regions in sorted(wanted.items()):
        regions.sort()
        items = [index.items[i] for i, _, _ in regions]
        slack = [int(index.budget[i]) for i, _, _ in regions]
        low, high = [a - s for (_, a, _), s in zip(regions, slack, strict=True)], [b + s for (_, _, b), s in zip(regions, slack, strict=True)]
        best, end = aligned(xs[t], items, low, high, slack)
        for r, (i, _, _) in enumerate(regions):
            if best[r] <= index.budget[i]:
                stop = min(int(end[r]), len(xs[t]))
                head = xs[t][max(0, stop - len(items[r]) - 2 * slack[r] - 1) : stop][::-1]
                _, back = banded_distances(head, [items[r][::-1]], [-slack[r]], [slack[r]])
                out.append((t, i, max(0, stop - int(back[0])), stop, int(best[r])))
    for i, short in index.short:
        for t, x in enumerate(xs):
            whole = "".join(map(chr, x.tolist()))
            at = whole.find(short)
            while at >= 0:
                out.append((t, i, at, at + len(short), 0))
                at = whole.find(short, at + 1)
    return out


def _indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator[ItemIndex]:
    """The items' indexes, in blocks of bounded size. Items without text or id are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("i is not null and length(t) > 0").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_CHARS)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        yield ItemIndex([r.i for r in rows], [r.t for r in rows])


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, start, end, edits): the regions of docs that hold an item within its edit budget.

    Touching regions of one item are one row, with its best alignment. Null and empty texts hold nothing; repeated rows are told repeatedly; an
    empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    schema = "id long, item_id long, start int, end int, edits int"
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], schema)
    for k, index in enumerate(_indexes(spark, benchmark)):
        shared = spark.sparkContext.broadcast(index)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches, limit=1 << 20):
                found = find(index, texts_of(batch))
                at = pa.array([f[0] for f in found], pa.int64())
                cols = [pa.array([index.ids[f[1]] for f in found], pa.int64()), *(pa.array([f[j] for f in found], pa.int32()) for j in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([column(batch, "id").take(at), *cols], ["id", "item_id", "start", "end", "edits"])

        found = rows.mapInArrow(run, schema)
        out = found if not k else out.unionByName(found)
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of a document that holds a benchmark item."""
    out = contaminations(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "edits")


def without_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item; every column stays, one pass for each block of items and no shuffle."""
    spark = docs.sparkSession
    for index in _indexes(spark, benchmark):
        shared = spark.sparkContext.broadcast(index)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, limit=1 << 20):
                bad = {f[0] for f in find(shared.value, texts_of(batch))}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64()))

        docs = bounded(docs).mapInArrow(run, docs.schema)
    return docs
