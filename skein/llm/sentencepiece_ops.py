"""SentencePiece encoding and decoding by a batched Viterbi over the piece lattice.

The model file is read for its pieces, scores and types; no training and no call of the library's encoder takes place on the main path.

Text is normalised as the models with an identity normaliser do (a blank in front, blanks to U+2581) and cut where no
piece can span: before a blank mark that follows another character. The distinct words of a slice are encoded once, those of equal length together: at each
end position the substrings of every length are hashed, the hashes probe the sorted keys of the pieces, and the best
admissible piece for each word and its length are stored as backpointers, which are then followed from the ends, again for all words
of a length at once.

Long words (text without blanks, codes) take the same way: they are cut between characters that no piece holds side by side, filled up to a common length with a
character that no piece holds, and, where they are longer than that, advance as overlapping windows. A window's lattice is that of the whole word from where it
agrees with the window before it over the longest piece's length; windows that do not come to agree are made longer, at last as long as the word.

Which path is best depends on the model type:

* unigram: the sum of the pieces' log probabilities is greatest (an unknown character costs the lowest score less 10).
* bpe: merges by rank have exactly one outcome, and a sequence is that outcome if and only if each pair of neighbours is
  stable, that is, merging their joined text gives the same two pieces again. So a transition between two pieces is admissible if the pair is
  stable; one path is left, and there is nothing to maximise. Stability is memoised by pair. A plain sum of scores would give
  other ids than the model's own.

Characters without a piece become their UTF-8 bytes' pieces (byte fallback) or the unknown id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, column, load, slices, texts_of, tidy

#: The vocabulary file of the query and the pipeline; a parameter of every operator here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Words longer than this are cut where no piece spans, and filled up to a multiple of it.
_LONG = 48
#: Words longer than this are encoded in windows, which begin _STRIDE characters apart (a multiple of many short periods, so that windows over
#: repeated patterns begin alike) or up to _SHIFTS less.
_WHOLE = 3_840
_STRIDE = 480
_SHIFTS = 96
_CELLS = 1 << 20
_FILLER = 0x10FFFF
_MEMO_WORDS = 300_000
_MEMO_CHARS = 8 << 20
_SLICE = 3 << 20
#: Stable pairs are kept in a table of fixed size; a newer pair takes the place of an older one with the same slot.
_PAIR_BITS = 21
_FILTER_BITS = 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


class PieceModel:
    """Pieces of a model file: normal and user-defined ones can be matched, bytes and the unknown id are the fallback."""

    def __init__(self, path: str, kind: str | None = None):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with an identity normaliser that keep white space are read")
        self.kind = kind or {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = np.array([p.score for p in proto.pieces], np.float64)
        kinds = np.array([p.type for p in proto.pieces])
        self.unknown = int(np.flatnonzero(kinds == 2)[0])
        self.bytes = {int(self.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(kinds == 6)} if (kinds == 6).sum() == 256 else {}
        matched = np.flatnonzero((kinds == 1) | (kinds == 4))
        self.ids = {self.pieces[i]: int(i) for i in matched.tolist()}
        self.longest = max(map(len, self.ids))
        if any(chr(_FILLER) in p for p in self.ids):
            raise ValueError("a piece holds the character that words are filled up with")
        # Characters that stand side by side in a piece; between any others a word can be cut.
        self.joints = np.unique(np.array([ord(x) << 32 | ord(y) for p in self.ids for x, y in zip(p, p[1:], strict=False)], np.int64))
        self.low = float(self.scores[matched].min()) - 10
        # What a piece writes: bytes as such, controls nothing, blanks for their marks.
        self.written = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else b" \xe2\x81\x87 " if k == 2 else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, kinds.tolist(), strict=True)]
        # Sorted keys by length: hash of the piece's characters -> id
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[str]] = {}
        for p in self.ids:
            by_length.setdefault(len(p), []).append(p)
        for n, group in by_length.items():
            grid = np.frombuffer("".join(group).encode("utf-32-le"), "<u4").reshape(-1, n)
            h = np.zeros(len(group), _U)
            for c in range(n):
                h = h * _BASE + grid[:, c] + _U(1)
            h = _finish(h)
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces of one length share a hash")
            near = np.zeros(1 << _FILTER_BITS, bool)  # most substrings are no piece: a glance at the hash's top bits says so
            near[h >> _U(64 - _FILTER_BITS)] = True
            self.keys[n] = h[order], np.array([self.ids[p] for p in group], np.int32)[order], near
        self.pair_keys, self.pair_values = np.zeros(1 << _PAIR_BITS, np.int64), np.zeros(1 << _PAIR_BITS, bool)
        self.memo = _Words()

    # Ids below -1 stand for a character without a piece: -2 - code point.
    def _text(self, i: int) -> str:
        return self.pieces[i] if i >= 0 else chr(-2 - i)

    def merge(self, text: str) -> list[str]:
        """The outcome of merging by rank: the best-scored adjacent pair first, of equal ones the leftmost."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def pair_is_stable(self, a: int, b: int) -> bool:
        return bool(self._pairs(np.array([a]), np.array([b]))[0])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a and b gives them again."""
        key = (a.astype(np.int64) << 32) ^ (b.astype(np.int64) & 0xFFFFFFFF) ^ (1 << 62)  # never zero
        slot = (key.view(_U) * _BASE >> _U(64 - _PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero(self.pair_keys[slot] != key)
        good = self.pair_values[slot]
        if len(new):
            fresh, at, place = np.unique(key[new], return_index=True, return_inverse=True)
            values = np.empty(len(fresh), bool)
            for k, (i, j) in enumerate(zip(a[new[at]].tolist(), b[new[at]].tolist(), strict=True)):
                x, y = self._text(i), self._text(j)
                values[k] = self.merge(x + y) == [x, y]
            good[new] = values[place]
            self.pair_keys[slot[new[at]]], self.pair_values[slot[new[at]]] = fresh, values
        return good

    def lattice(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, length, piece) of the last piece of the best path to each end, by end and row, for rows of characters that advance together."""
        rows, n = grid.shape
        sums = np.zeros((n + 1, rows), _U)
        powers = [_U(1)]
        with np.errstate(over="ignore"):
            for c in range(n):
                sums[c + 1] = sums[c] * _BASE + grid[:, c] + _U(1)
                powers.append(powers[-1] * _BASE)
            bpe = self.kind == "bpe"
            best = np.full((n + 1, rows), -np.inf)
            best[0] = 0
            step = np.zeros((n + 1, rows), np.int8 if self.longest < 128 else np.int32)
            piece = np.full((n + 1, rows), -1, np.int32)
            every = np.arange(rows)
            for end in range(1, n + 1):
                for size in range(min(end, self.longest), 0, -1):
                    live = np.flatnonzero(step[end] == 0) if bpe else every
                    if not len(live):
                        break
                    start = end - size
                    got = None
                    if size in self.keys:
                        keys, ids, near = self.keys[size]
                        h = _finish(sums[end, live] - sums[start, live] * powers[size])
                        if size > 1:
                            maybe = np.flatnonzero(near[h >> _U(64 - _FILTER_BITS)])
                            live, h = live[maybe], h[maybe]
                        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                        got = np.where(keys[at] == h, ids[at], np.int32(-1))
                    elif size > 1:
                        continue
                    if size == 1:
                        alone = -2 - grid[live, start].astype(np.int32)
                        got = alone if got is None else np.where(got < 0, alone, got)
                    real = got != -1
                    live, got = live[real], got[real]
                    if not len(live):
                        continue
                    if bpe:
                        if start:
                            good = self._pairs(piece[start, live], got)
                            live, got = live[good], got[good]
                        score = best[start, live] + 1
                    else:
                        score = best[start, live] + np.where(got >= 0, self.scores[np.maximum(got, 0)], self.low)
                        better = score > best[end, live]
                        live, got, score = live[better], got[better], score[better]
                    best[end, live], step[end, live], piece[end, live] = score, size, got
        return best, step, piece

    @staticmethod
    def _grid(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The words' characters, filled up to n, and how many each lacked."""
        lacking = n - np.fromiter(map(len, words), np.int64, len(words))
        filled = "".join([w + chr(_FILLER) * k for w, k in zip(words, lacking.tolist(), strict=True)]) if lacking.any() else "".join(words)
        return np.frombuffer(filled.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n), lacking

    def encode_together(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most n characters, all advancing together: one word's after the other's, and how many each has."""
        grid, lacking = self._grid(words, n)
        rows = len(words)
        _, step, piece = self.lattice(grid)
        path = np.empty((n, rows), np.int32)
        taken = np.zeros(rows, np.int64)
        at = np.full(rows, n)
        live = np.arange(rows)
        for depth in range(n):
            end = at[live]
            path[depth, live] = piece[end, live]
            taken[live] += 1
            at[live] = end - step[end, live]
            live = live[at[live] > 0]
            if not len(live):
                break
        # Read from the last depth up, a word's pieces are in order; what filled it up comes last.
        deep = int(taken.max())
        turned = path[:deep][::-1].T
        depth = np.arange(deep)[None, :]
        inside = (depth >= deep - taken[:, None]) & (depth < deep - lacking[:, None])
        flat = turned[inside]
        sizes = taken - lacking
        if flat.min() >= 0:
            return flat, sizes
        ends = np.cumsum(sizes).tolist()
        spelled = [self._spell(flat[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return np.fromiter(chain.from_iterable(spelled), np.int32), np.array([len(x) for x in spelled])

    def cut(self, word: str) -> list[str]:
        """A word in parts between which no piece lies."""
        x = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pair = x[:-1] << 32 | x[1:]
        at = np.minimum(np.searchsorted(self.joints, pair), len(self.joints) - 1) if len(self.joints) else np.zeros(len(pair), np.int64)
        apart = self.joints[at] != pair if len(self.joints) else np.ones(len(pair), bool)
        if not self.bytes:  # neighbouring unknown characters are one and stay together
            known = np.array([c in self.ids for c in word])
            apart &= known[:-1] | known[1:]
        cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_windows(self, words: list[str], stride: int = _STRIDE, shifts: int = _SHIFTS) -> list[tuple[int, ...]]:
        """Ids of words of any length, as windows that advance together, those of all words at once.

        Windows follow each other every `stride`, and overlap. One that does not come to agree with the window before it (a repeated pattern has
        places of its own to begin at) gives way to those that begin up to `shifts` earlier; if none of them agrees, the window before it goes on twice as long.
        """
        lap = 4 * self.longest + 32
        stride = max(stride, lap + shifts + self.longest)
        wide = stride + lap
        runs = [_Stitched(w, self.longest, self.kind == "bpe") for w in words]
        pending = runs
        while pending:
            rows = [(run, h) for run in pending for h in run.heads(stride, lap, shifts)]
            for at in range(0, len(rows), max(1, _CELLS // wide)):
                part = rows[at : at + max(1, _CELLS // wide)]
                tables = self.lattice(self._grid([run.word[h : h + wide] for run, h in part], wide)[0])
                for r, (run, h) in enumerate(part):
                    run.take(h, [x[: min(wide, len(run.word) - h) + 1, r] for x in tables])
            for run in pending:
                if run.stuck():
                    size = min(len(run.word) - run.head, 2 * run.size)
                    run.accept(run.head, 0, [x[:, 0] for x in self.lattice(self._grid([run.word[run.head : run.head + size]], size)[0])])
            pending = [run for run in pending if run.head + run.size < len(run.word)]
        return [self._spell(run.path()) for run in runs]

    def _spell(self, path: list[int]) -> tuple[int, ...]:
        if min(path) >= 0:
            return tuple(path)
        out: list[int] = []
        for i in path:
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one
                out.append(self.unknown)
        return tuple(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text; an empty text has none."""
        memo = self.memo
        if len(memo.number) > _MEMO_WORDS or memo.chars > _MEMO_CHARS:
            memo.clear()
        front = BLANK if self.prefix else ""
        split = [_WORDS.findall(front + text.replace(" ", BLANK)) if text else [] for text in texts]
        split = [[p for w in words for p in (self.cut(w) if len(w) > _LONG else (w,))] if words and max(map(len, words)) > _LONG else words for words in split]
        missing: dict[int, list[str]] = {}
        for w in set().union(*split).difference(memo.number):
            n = len(w)
            unit = 1 if n <= _LONG else _LONG if n <= 10 * _LONG else 10 * _LONG
            missing.setdefault(-(-n // unit) * unit if n <= _WHOLE else 0, []).append(w)
        for n, words in missing.items():
            if not n:
                spelled = self.encode_windows(words)
                memo.add(words, np.fromiter(chain.from_iterable(spelled), np.int32), np.array([len(x) for x in spelled]))
                continue
            few = max(1, min(8_000, _CELLS // n))
            for at in range(0, len(words), few):
                part = words[at : at + few]
                memo.add(part, *self.encode_together(part, n))
        return [memo.spell(words) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids. Bytes that are no UTF-8 become U+FFFD; an id outside the model is an error."""
        written = self.written
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(written):
            raise ValueError(f"ids outside the model: {ids.min()} to {ids.max()}")
        text = b"".join([written[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Stitched:
    """A long word's lattice, put together from windows: the length and the piece of the last piece to each end, as far as it is known."""

    def __init__(self, word: str, reach: int, bpe: bool):
        self.word, self.reach, self.bpe = word, reach, bpe
        self.step, self.piece = np.zeros(len(word) + 1, np.int32), np.zeros(len(word) + 1, np.int32)
        self.head = self.size = 0
        self.last: list[np.ndarray] = []
        self.searching = self.sought = self.closed = False

    def heads(self, stride: int, lap: int, shifts: int) -> list[int]:
        """Where the windows of the next round begin: in a row from the end of what is known, or each other's alternatives."""
        self.closed, self.sought = False, self.searching
        follow = max(0, self.head + self.size - lap)
        if self.searching:
            return list(range(follow - 1, max(self.head, follow - 1 - shifts), -1))
        return list(range(follow, max(follow + 1, len(self.word) - lap), stride))

    def take(self, h: int, own: list[np.ndarray]) -> None:
        """Adds a window if it agrees with the last one; from the first that doesn't on, those of a row are of no use, nor are others of an alternative that does."""
        if self.closed:
            return
        begin = self._agreement([x[h - self.head :] for x in self.last], own) if self.last else 0
        self.closed = (begin is None) != self.sought
        if begin is not None:
            self.accept(h, begin, own)

    def _agreement(self, before: list[np.ndarray], own: list[np.ndarray]) -> int | None:
        """The first end from which both lattices are one: they agree on as many ends as the longest piece has characters, which is how far back a step looks."""
        k = min(len(before[0]), len(own[0]))
        (b0, s0, p0), (b, s, p) = ([x[:k] for x in tables] for tables in (before, own))
        same = (s == s0) & (p == p0)
        same[0] = False
        if not self.bpe:
            same[1:] &= np.abs(np.diff(b[1:] - b0[1:], prepend=b[1] - b0[1])) < 1e-9
        run = np.convolve(same, np.ones(self.reach, int))[:k] == self.reach
        return int(np.argmax(run)) if run.any() else None

    def accept(self, h: int, begin: int, own: list[np.ndarray]) -> None:
        self.step[h + begin : h + len(own[1])], self.piece[h + begin : h + len(own[1])] = own[1][begin:], own[2][begin:]
        self.head, self.size, self.last = h, len(own[1]) - 1, [x.copy() for x in own]
        self.searching = False

    def stuck(self) -> bool:
        """After a round: whether the last window has to go on alone. Before that, alternatives are tried."""
        if self.head + self.size < len(self.word) and not self.sought:
            self.searching = True
            return False
        return self.searching

    def path(self) -> list[int]:
        step, piece, out, at = self.step.tolist(), self.piece.tolist(), [], len(self.word)
        while at:
            out.append(piece[at])
            at -= step[at]
        return out[::-1]


class _Words:
    """Ids of the words met so far, packed: a word's number, and where its ids are in one array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        old, n = len(self.number), len(words)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        if old + n > len(self.begin):
            more = max(len(self.begin), n)
            self.begin, self.size = np.concatenate([self.begin, np.zeros(more, np.int64)]), np.concatenate([self.size, np.zeros(more, np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[old : old + n] = self.used + np.cumsum(sizes) - sizes
        self.size[old : old + n] = sizes
        self.used += len(ids)
        self.chars += sum(map(len, words))
        self.number.update(zip(words, range(old, old + n), strict=True))

    def spell(self, words: list[str]) -> np.ndarray:
        k = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        sizes = self.size[k]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.begin[k] - (ends - sizes), sizes) + np.arange(ends[-1] if len(k) else 0)]


@lru_cache(maxsize=4)
def model(path: str = MODEL, kind: str | None = None) -> PieceModel:
    """A worker's copy of a model, kept with what it has memoised."""
    return PieceModel(path, kind)


def encode(docs: DataFrame, path: str = MODEL, kind: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with an array of ids for each text. A null or empty text has an empty array; every row and column stays.

    A column that is already named ids_col is replaced.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path, kind)
        for batch in slices(batches, text_col, _SLICE):
            got = pieces.encode(texts_of(batch, text_col))
            ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, ids_col])
        pieces.memo.clear()

    docs = bounded(docs).drop(ids_col)
    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("array<int>").alias(ids_col)).schema)


def decode(rows: DataFrame, path: str = MODEL, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of each array of ids; null arrays give an empty text, null ids and ids outside the model fail."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            got = [pieces.decode(np.array(x or [], np.int64)) for x in column(batch, ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, text_col])

    rows = bounded(rows).drop(text_col)
    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(text_col)).schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    """Every document's ids as a digest, their number, and the digest of the text decoded from them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in slices(batches, limit=_SLICE):
            texts = texts_of(batch)
            got = pieces.encode(texts)
            back = [pieces.decode(x) for x in got]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array([len(x) for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in got]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                    pa.array([x == y for x, y in zip(texts, back, strict=True)]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )
        pieces.memo.clear()

    docs = bounded(load(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
