from __future__ import annotations

import random

from skein.llm import decontam as D


def test_neighbouring_texts_of_a_repeating_item():
    item = "again and again " * 6
    index = D.ItemIndex([4], [item])
    for n in (1, 3, 4, 9):
        for around in ([], ["some other text that has none of it"]):
            texts = [*around, *[item] * n, *around]
            got = {f[0] for f in D.find(index, texts)}
            assert got == {t for t, x in enumerate(texts) if x == item}, (n, got)
    texts = [item * 3, "", item, "again", item[3:], item * 2]
    alone = {t for t, x in enumerate(texts) if D.find(index, [x])}
    assert {f[0] for f in D.find(index, texts)} == alone == {0, 2, 4, 5}


def test_every_place_of_a_short_item():
    index = D.ItemIndex([1, 2], ["tiny", "aa"])
    got = sorted(f[1:4] for f in D.find(index, ["tiny and TINY", "none"]))
    assert got == [(0, 0, 4), (0, 9, 13)]
    assert sorted(f[2] for f in D.find(index, ["xaaa"])) == [1, 2]


def test_regions_do_not_depend_on_the_texts_beside():
    rng = random.Random(3)
    for _ in range(300):
        unit = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 7)))
        item = (unit * 80)[: rng.randint(20, 90)]
        other = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(12, 60)))
        index = D.ItemIndex([1, 2], [item, other])
        pieces = lambda: [item, other, item[: len(item) // 2], "", "zq vv " * rng.randint(0, 9), unit * rng.randint(0, 9)]
        texts = ["".join(rng.choice(pieces()) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(2, 8))]
        alone = [(t, *f[1:]) for t, x in enumerate(texts) for f in D.find(index, [x])]
        assert sorted(D.find(index, texts)) == sorted(alone), (item, other, texts)
        assert {t for t, x in enumerate(texts) if item in x} <= {f[0] for f in alone if f[1] == 0}
