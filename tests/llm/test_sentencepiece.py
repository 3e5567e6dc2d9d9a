from __future__ import annotations

import random
import time

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from skein.llm import sentencepiece_ops as S

ODD = [
    "", "  a  b ", "▁x▁▁y", "a\tb\nc", "é" * 100, "日本語テキスト test 😀😀 ́x", "    indented   code(x)\n\n\n", "<s> </s> <unk> <0x41>", "\x00\x01abc", " ", "a" * 3000,
    "supercalifragilisticexpialidocious" * 9, "ﷺ ﬁ ½ Ⅷ", "x" + " " * 40 + "y", "​﻿z", "The quick brown fox. " * 50,
]


def texts():
    rng = random.Random(1)
    pool = [range(32, 127), range(160, 0x500), range(0x3000, 0x9FFF), [32]]
    return ODD + ["".join(chr(rng.choice(rng.choice(pool))) for _ in range(rng.randint(1, 90))) for _ in range(300)]


def test_bpe_equals_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    own = S.PieceModel(S.MODEL)
    ids = own.encode(texts())
    assert [x.tolist() for x in ids] == library.encode(texts())
    assert [own.decode(x) for x in ids] == library.decode([x.tolist() for x in ids])
    for t, x in zip(texts(), ids, strict=True):
        assert own.decode(x) == t.replace("▁", " ")


def test_unigram_equals_the_library(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(S.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    rng = np.random.default_rng(0)
    for p in proto.pieces:
        if p.type == 1:
            p.score = float(np.float32(-1 - abs(rng.normal(6, 2))))
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), S.PieceModel(path)
    assert own.kind == "unigram"
    same = [x.tolist() == y for x, y in zip(own.encode(texts()), library.encode(texts()), strict=True)]
    assert np.mean(same) > 0.99  # the library adds in single precision


def test_long_words_and_small_memo_change_nothing(monkeypatch):
    own = S.PieceModel(S.MODEL)
    want = [x.tolist() for x in own.encode(texts())]
    monkeypatch.setattr(S, "_LONG", 3)
    assert [x.tolist() for x in S.PieceModel(S.MODEL).encode(texts())] == want
    monkeypatch.setattr(S, "_MEMO_WORDS", 5)
    small = S.PieceModel(S.MODEL)
    assert [small.encode([t])[0].tolist() for t in texts()] == want


def long_texts():
    rng = random.Random(6)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    out = [draw("0123456789abcdef", n) for n in (49, 64, 479, 480, 481, 900, 5000)] + [draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3000)]
    out += [chr(c) * n for c in (97, 61, 45, 48, 0x9) for n in (481, 1000, 4097, 7001)] + ["ab" * 1500, "abc" * 1001, "-=" * 2000, "a" * 700 + "b" + "a" * 900, "the" * 900, "=" * 601 + "x" + "=" * 599]
    out += ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(4000)), "日本語のテキスト" * 700, "ไทยไม่มีช่องว่าง" * 300, "".join(draw(rng.choice(["ing", "th", "er", "_", "."]), 3) for _ in range(900))]
    return out + ["".join(rng.choice(["function", "(", ")", "var", "=", ";", "{", "}", "return", "x1"]) for _ in range(1500)), "é" * 2000, "\U0001f600" * 600]


def test_long_words_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    own = S.PieceModel(S.MODEL)
    assert [x.tolist() for x in own.encode(long_texts())] == library.encode(long_texts())


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_windows_change_nothing(monkeypatch, kind):
    """Words as windows of several strides, with and without others to choose from, and as one."""
    whole = S.PieceModel(S.MODEL, kind)
    words = [w for t in long_texts() for w in S._WORDS.findall(S.BLANK + t[:700])]
    want = [whole.encode_together([w], len(w))[0].tolist() for w in words]
    assert [whole.encode_together([w], len(w) + 40)[0].tolist() for w in words] == want
    monkeypatch.setattr(S, "_CELLS", 1 << 14)
    for stride, shifts in ((1, 0), (1, 5), (211, 40)):
        assert [list(x) for x in whole.encode_windows(words, stride, shifts)] == want
    assert all("".join(whole.cut(w)) == w for w in words)


def test_a_long_word_takes_little_time():
    rng = random.Random(2)
    own = S.PieceModel(S.MODEL)
    for text in ("a" * 300_000, "".join(rng.choice("0123456789abcdef") for _ in range(300_000)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300_000))):
        began = time.process_time()
        (ids,) = own.encode([text])
        assert time.process_time() - began < 20 and own.decode(ids) == text


def test_ids_outside_the_model_are_refused():
    own = S.PieceModel(S.MODEL)
    for ids in ([-1], [5, 10**6]):
        with pytest.raises(ValueError, match="outside"):
            own.decode(np.array(ids))


def test_operators(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "héllo wörld", "z"), (3, "héllo wörld", "z"), (None, "z" * 50_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = S.decode(S.encode(docs))
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert sorted((r.text or "") == r.decoded for r in got) == [True] * 5 and [r.ids for r in got if not r.text] == [[], []]
    assert S.encode(docs.withColumn("ids", F.lit("old"))).schema["ids"].dataType.simpleString() == "array<int>"
    assert S.encode(docs.where("false")).count() == 0


def test_query_round_trips(spark, sf):
    out = S.op1_sentencepiece(spark, sf)
    assert out.where("not round_trip").count() == 0
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_other_normalisers_are_refused(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(S.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="identity"):
        S.PieceModel(str(tmp_path / "m.model"))
