"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct 4-word shingles. Rows with equal sets are one class. A class gets HASHES minimal values; BANDS bands of ROWS values propose
candidates (a pair at the threshold of 0.8 shares no band in 1 of 8 million cases), and one bit of every value is kept in words of 64. The bits of
two classes differ with probability (1 - J) / 2, so after each word the posterior of J >= 0.8 given the differences so far, under an even prior on
J, says whether the pair may still reach it: it is dropped where that is less than MISS. Survivors are verified on their full sets.

Components don't need every pair, and groups of copies would have very many. So links are found in two steps:

* In each of STARS rounds every band bucket names one member its hub; each component (a class, at first) takes the hub of another component that is nearest
  to one of its members by their bits, and that pair is verified. Groups fall together around hubs with one pair a component and round.
* Only buckets that then hold several components matter. Two components that meet in one are compared as wholes, in blocks of bounded size: candidates by their
  bits, then full sets, and one link is enough. All pairs that share a band have by then been compared, or are in one component already.

Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, column, components, load, slices, stored, tidy

SHINGLE = 4
#: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
HASHES = 384
BANDS = 40
ROWS = 5
WORDS = HASHES // 64
#: Chance of a pair at the threshold being dropped by its bits.
MISS = 1e-5
#: Rounds of stars before components are compared as wholes; more of them leave less to that.
STARS = 2
#: Shingles in a block of sets; a set counts MEMBER more, so that a block holds few thousands of small ones.
BLOCK = 1 << 16
MEMBER = 64
#: Bits of the filter that picks the texts whose sets are needed.
FILTER_BITS = 26
MEMO = 500_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_DRAWN = np.random.default_rng(20240613)
_FACTORS = _DRAWN.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_ADDED = _DRAWN.integers(0, 1 << 32, HASHES, np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    """64-bit values, well mixed."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO:
            self[word] = h
        return h


def shingles(data: bytes, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than a shingle are one, no word is none."""
    words = data.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += w[k : k + n] * _PLACES[k]
    return np.unique(_mix(out))


def signature(values: np.ndarray) -> np.ndarray:
    """HASHES least values of a set of hashes."""
    x = (values ^ (values >> np.uint64(32))).astype(np.uint32)[:, None]
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 2_048):
        np.minimum(least, (x[s : s + 2_048] * _FACTORS + _ADDED).min(axis=0), out=least)
    return least


def _band_keys(signs: np.ndarray) -> np.ndarray:
    """BANDS keys of each signature."""
    parts = signs[:, : BANDS * ROWS].astype(np.uint64).reshape(len(signs), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signs), BANDS)).copy()
    for k in range(ROWS):
        h = _mix(h * _PLACES[0] + parts[:, :, k])
    return h


def _bits(signs: np.ndarray) -> np.ndarray:
    """One bit of each value, as WORDS words."""
    h = _mix(signs.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)))
    return np.packbits((h & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


_PRINTS = "id long, n long, h1 long, h2 long, keys array<long>, " + ", ".join(f"b{k} long" for k in range(WORDS))


@tidy
def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in slices(batches):
        sizes, names, signs = [], [], []
        for text in column(batch, "text").cast(pa.binary()).to_pylist():
            s = shingles(text or b"", hashes)
            sizes.append(len(s))
            names.append(xxhash.xxh3_128_digest(s.tobytes()))
            signs.append(signature(s))
        signs = np.stack(signs)
        both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        keys = _band_keys(signs).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        bits = _bits(signs)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "id"), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists, *(pa.array(bits[:, k]) for k in range(WORDS))],
            ["id", "n", "h1", "h2", "keys", *(f"b{k}" for k in range(WORDS))],
        )


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, h1, h2, keys, b0 ..): size and identity of each row's set, its band keys and its bits."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_print_batches, _PRINTS)


def allowed(miss: float = MISS, threshold: int = THRESHOLD) -> list[int]:
    """The most differing bits after each word with which the posterior of the threshold is still `miss` or more."""
    p = (np.arange(100_000) + 0.5) / 200_000  # chance of a differing bit, 0 to 1/2
    near = p <= (1 - threshold / 100) / 2
    out = []
    for words in range(1, WORDS + 1):
        n = 64 * words
        best = -1
        for d in range(n + 1):
            log = d * np.log(p) + (n - d) * np.log1p(-p)
            density = np.exp(log - log.max())
            if density[near].sum() / density.sum() < miss:
                break
            best = d
        out.append(best)
    return out


def _may_link(a: str, b: str, most: list[int]) -> Column:
    """Whether sizes and bits of two sides leave the threshold possible. Words are compared one after another."""
    differing: Column = F.lit(0)
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    out = small * 100 >= large * THRESHOLD
    for k, bound in enumerate(most):
        differing = differing + F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}")))
        out = out & (differing <= bound)
    return out


def _differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(WORDS)), F.lit(0))


def _filter_places(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """Packed bits that mark the ids (id): a filter of 2**FILTER_BITS bits that errs on one side only."""

    @tidy
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _filter_places(np.asarray(column(batch, "id")).astype(np.int64))
            for block in np.unique(at >> 19).tolist():
                part = held.setdefault(block, np.zeros(1 << 19, bool))
                part[at[at >> 19 == block] & ((1 << 19) - 1)] = True
        for block, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["block", "marks"])

    @tidy
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(column(batch, "block").to_pylist(), column(batch, "marks").to_pylist(), strict=True):
                held[block] = held.get(block, np.uint8(0)) | np.frombuffer(data, np.uint8)
        for block, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "marks"])

    kind = "block int, marks binary"
    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    size = 1 << 16
    for r in ids.mapInArrow(marks, kind).repartition("block").mapInArrow(merged, kind).toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(bytes(r.marks), np.uint8)
    return out


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h1, values array<long>) of the sets of the wanted ids (id), once for each id and set. Other texts are left out before their sets are made."""
    wanted = _filter(ids)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            known = column(batch, "id")
            at = _filter_places(np.asarray(known.fill_null(0)).astype(np.int64))
            hit = ((wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & np.asarray(known.is_valid())
            for part in slices(iter([batch.filter(pa.array(hit))])):
                values = [shingles(x or b"", hashes) for x in column(part, "text").cast(pa.binary()).to_pylist()]
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in values), np.int64).reshape(-1, 2)[:, 0]
                ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))
                yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(names), lists], ["id", "h1", "values"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(run, "id long, h1 long, values array<long>")
    return made.groupBy("id", "h1").agg(F.any_value("values").alias("values"))


def _linked(a: Column, b: Column) -> Column:
    """Whether two full sets reach the threshold."""
    common = F.size(F.array_intersect(a, b)).cast("long")
    return common * 100 >= (F.size(a) + F.size(b) - common) * THRESHOLD


def _compare(most: list[int]):
    """Task function: of each block of small components (x) and block of a large one (y) the first link of each small component that has one."""

    def parse(side: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(v) for v in side["values"]], np.int64)
        values = np.concatenate([np.asarray(v, np.int64) for v in side["values"]]).view(np.uint64)  # in their order as unsigned
        return np.array(side["id"], np.int64), np.array(side["bits"], np.int64).view(np.uint64).reshape(-1, WORDS), sizes, values

    def links(comps: list[int], a, b) -> Iterator[tuple[int, int]]:
        ids_a, bits_a, n_a, v_a = a
        ids_b, bits_b, n_b, v_b = b
        small, large = np.minimum(n_a[:, None], n_b), np.maximum(n_a[:, None], n_b)
        i, j = np.nonzero(100 * small >= THRESHOLD * large)
        far = np.zeros(len(i), np.int64)
        for k, bound in enumerate(most):
            far += np.bitwise_count(bits_a[i, k] ^ bits_b[j, k])
            keep = far <= bound
            i, j, far = i[keep], j[keep], far[keep]
        order = np.argsort(far, kind="stable")
        starts_a, starts_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        done: set[int] = set()
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if comps[x] in done:
                continue
            s, t = v_a[starts_a[x] : starts_a[x] + n_a[x]], v_b[starts_b[y] : starts_b[y] + n_b[y]]
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            both = int((t[at] == s).sum())
            if 100 * both >= THRESHOLD * (len(s) + len(t) - both):
                done.add(comps[x])
                yield int(ids_a[x]), int(ids_b[y])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(column(batch, "x"), column(batch, "y"), strict=True):
                x, y = one.as_py(), other.as_py()
                if found := list(links(x["comp"], parse(x), parse(y))):
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["u", "v"])

    return run


def _blocks(rows: DataFrame, of: str) -> DataFrame:
    """(of, block): rows (of, comp, id, n, b0 .., values) of each `of` in blocks of bounded size. A large one is dealt over tasks before it is gathered."""
    cost = F.ceil(F.sum(F.col("n") + MEMBER) / BLOCK)
    total = rows.groupBy(F.col(of).alias("of")).agg(cost.alias("deals"))
    dealt = rows.join(total, F.col(of) == F.col("of")).withColumn("deal", F.pmod(F.xxhash64("id", "n"), F.col("deals")))
    bits = F.array(*[f"b{k}" for k in range(WORDS)])
    wanted = F.struct("comp", "id", bits.alias("bits"), "values")
    packed = dealt.select(of, "deal", wanted.alias("row")).repartition(of, "deal").groupBy(of, "deal").agg(F.collect_list("row").alias("r"))
    return packed.select(of, F.struct(F.col("r.comp").alias("comp"), F.col("r.id").alias("id"), F.flatten("r.bits").alias("bits"), F.col("r.values").alias("values")).alias("block"))


def _block_links(pairs: DataFrame, members: DataFrame, most: list[int]) -> DataFrame:
    """(u, v): links between the paired components (x, y), at least one for each pair that has any. members: (comp, id, n, b0 .., values), values sorted.

    Of a pair the larger component is told in its blocks, once for all its pairs; the members of all the smaller ones that it meets are packed into blocks of
    their own. A block of either kind moves once, however many it is compared with.
    """
    total = members.groupBy("comp").agg(F.sum(F.col("n") + MEMBER).alias("total"))
    sized = pairs.join(total.select(F.col("comp").alias("x"), F.col("total").alias("tx")), "x").join(total.select(F.col("comp").alias("y"), F.col("total").alias("ty")), "y")
    ranked = sized.select(F.when(F.col("tx") >= F.col("ty"), F.col("x")).otherwise(F.col("y")).alias("big"), F.when(F.col("tx") >= F.col("ty"), F.col("y")).otherwise(F.col("x")).alias("small"))
    ranked = stored(ranked)
    large = _blocks(members.join(ranked.select(F.col("big").alias("own")).distinct(), F.col("comp") == F.col("own"), "left_semi").withColumn("own", F.col("comp")), "own")
    small = _blocks(ranked.join(members, F.col("small") == F.col("comp")).drop("small"), "big")
    both = small.select("big", F.col("block").alias("x")).join(large.select("own", F.col("block").alias("y")), F.col("big") == F.col("own")).select("x", "y")
    return both.mapInArrow(_compare(most), "u long, v long")


def _stars(members: DataFrame, comp: DataFrame | None, facts: DataFrame, sets: DataFrame, most: list[int], turn: int) -> DataFrame:
    """(u, v): verified links, one pair a component at most. members: (key, rep); comp: (node, component) so far."""
    of = lambda df, rep, name: df.withColumn(name, F.col(rep)) if comp is None else df.join(comp.select(F.col("node").alias("at"), F.col("component").alias(name)), F.col(rep) == F.col("at"), "left").drop("at").withColumn(name, F.coalesce(name, rep))
    placed = of(members, "rep", "comp")
    # The member with the least hash is the hub, so that no id is every bucket's hub and each round has others.
    least = placed.groupBy(F.col("key").alias("k")).agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "comp")).alias("hub"), F.min("comp").alias("a"), F.max("comp").alias("z"))
    hubs = least.where("a <> z").select("k", F.col("hub.rep").alias("hub"), F.col("hub.comp").alias("hub_comp"))
    star = placed.join(hubs, F.col("key") == F.col("k")).where("comp <> hub_comp").select("rep", "comp", "hub").distinct()
    near = star.join(facts.alias("a"), F.col("rep") == F.col("a.id")).join(facts.alias("b"), (F.col("hub") == F.col("b.id")) & _may_link("a", "b", most))
    pairs = near.groupBy("comp").agg(F.min(F.struct(_differing("a", "b").alias("far"), F.col("rep").alias("u"), F.col("hub").alias("v"))).alias("best")).select("best.u", "best.v")
    left = pairs.join(sets.select(F.col("id").alias("iu"), F.col("values").alias("us")), F.col("u") == F.col("iu"))
    both = left.join(sets.select(F.col("id").alias("iv"), F.col("values").alias("vs")), (F.col("v") == F.col("iv")) & _linked(F.col("us"), F.col("vs")))
    return both.select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """(id, n, component_id) of each row: n is the size of its set, component_id the smallest id that links reach, the row's own included.

    Rows with equal sets are linked; a row without words (or with a null text) has an empty set and is linked with nothing. Repeated rows stay repeated; rows
    that share an id but not a set are told apart by their sets. A row with a null id gets the component of its set's other rows, if there are any, else null.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    most = allowed(miss)
    made = stored(prints(docs, id_col, text_col))
    words = [f"b{k}" for k in range(WORDS)]
    full = made.where("n > 0")
    classes = stored(full.where("id is not null").groupBy("n", "h1", "h2", *words, "keys").agg(F.min("id").alias("rep")))
    keyed = classes.select("rep", F.explode("keys").alias("key"))
    shared = keyed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("held")).where("held > 1")
    members = stored(keyed.join(shared, F.col("key") == F.col("k")).select("key", "rep"))
    facts = classes.select(F.col("rep").alias("id"), "n", "h1", *words)
    sets = stored(_sets(docs, members.select(F.col("rep").alias("id")), id_col, text_col))
    edges: DataFrame | None = None
    comp: DataFrame | None = None
    for turn in range(STARS):
        more = stored(_stars(members, comp, facts, sets, most, turn))
        edges = more if edges is None else edges.unionByName(more)
        comp = components(edges)
    # Buckets that hold several components. A component of one class brings its bits, so most pairs are settled as they meet.
    named = facts.join(comp, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "id"))
    sizes = named.groupBy(F.col("comp").alias("of")).agg(F.count("*").alias("classes"))
    named = stored(named.join(sizes, F.col("comp") == F.col("of")).select("id", "comp", "n", "h1", *words, "classes"))
    placed = members.join(named.select("id", "comp").distinct(), F.col("rep") == F.col("id")).select("key", "comp").distinct()
    mixed = placed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("held")).where("held > 1")
    open_ = stored(placed.join(mixed, F.col("key") == F.col("k")).select("key", "comp"))
    one = named.where("classes = 1").select(F.col("id").alias("only"), F.lit(True).alias("single"), "n", *words)
    sided = stored(open_.join(one, F.col("comp") == F.col("only"), "left").drop("only"))
    x, y = sided.alias("x"), sided.alias("y")
    several = F.col("x.single").isNull() | F.col("y.single").isNull()
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & (several | _may_link("x", "y", most))).select(F.col("x.comp").alias("x"), F.col("y.comp").alias("y")).distinct()
    met = stored(met)
    concerned = met.select(F.col("x").alias("c")).unionByName(met.select(F.col("y").alias("c"))).distinct()
    own_sets = sets.select(F.col("id").alias("i"), F.col("h1").alias("h"), "values")
    inside = named.join(concerned, F.col("comp") == F.col("c"), "left_semi").join(own_sets, (F.col("id") == F.col("i")) & (F.col("h1") == F.col("h")))
    more = _block_links(met, stored(inside.select("comp", "id", "n", *words, "values")), most)
    comp = components(edges.unionByName(more))
    final = classes.select("n", "h1", "h2", "rep").join(comp, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("component", "rep").alias("component_id"))
    own = made.select("id", "n", "h1", "h2")
    out = own.where("n > 0").join(final, (F.col("n") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left").select("id", "n", "component_id")
    return out.unionByName(own.where("n = 0").select("id", "n", F.col("id").alias("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component and whether it is the one that stays."""
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
