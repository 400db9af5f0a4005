"""Corpus operators on cases that a line, a length or a threshold once cut off."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
import numpy as np
from tidewater.llm import bpe, decontaminate, kernel, licenses, minhash
from tidewater.llm.queries import vocabulary
from test_llm_operators import _contained

WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
    "gpl": " * This program is free\n * software: you can\n * redistribute it and/or\n * modify it under the terms",
}


def test_license_notices_over_several_lines(spark):
    r = random.Random(4)
    names = licenses.vocabulary(licenses.defaults())
    filler = lambda n: " ".join("".join(r.choice("xyzq") for _ in range(5)) for _ in range(n))
    texts = [*WRAPPED.values(), *(f"{filler(r.randint(1, 90))}\n{t}\n{filler(30)}" for t in WRAPPED.values())]
    for t in r.choices(list(licenses.TEMPLATES), k=60):  # at any width of line
        ws, w = f"{filler(r.randint(0, 50))} {t} {filler(10)} {' '.join(r.sample(names, 4))}".split(), r.randint(2, 12)
        texts.append("\n".join(" ".join(ws[i : i + w]) for i in range(0, len(ws), w)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in licenses.scan(docs).collect()}
    for i, label in enumerate([*WRAPPED] * 2):
        assert label in got[i].labels.split(",")
    for i, t in enumerate(texts):
        found, best = _contained(t)
        assert set(filter(None, got[i].labels.split(","))) == found | set(filter(None, got[i].base_labels.split(",")))
        assert abs(got[i].score - (1.0 if got[i].n_base else best)) < 1e-12


def test_leaks_of_items_with_few_plain_words(spark):
    items = ["What is 17 times 23?", "12 * 7 = 84", "Who wrote Hamlet", "1 2 3 4 5 6 7 8 9 10 11 12", "too short", "", None, "...", "Did Ada Lovelace meet Charles Babbage in 1833 or in London 1834"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"Some words go before it: {t} Some more follow." for t in items[:5]]
    # an answer that runs into the last slot; other numbers; a changed order; a part
    texts += ["What is 17 times 23? 391", "What is 18 times 23?", "12 * 8 = 84", "What is 23 times 17?", "wrote Hamlet", "nothing of the kind", "", None, "we ask " + items[8] + " 12 times"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((x.doc_id, x.item_id, x.n_windows, x.coverage, x.n_changed) for x in decontaminate.leaks(docs, bench).collect())
    assert [x[:2] for x in got] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 0), (13, 8)]
    assert all(x[3] == 1.0 and x[4] == 0 for x in got)
    left = sorted(x.doc_id for x in decontaminate.clean(docs, bench).collect())
    assert left == [6, 7, 8, 9, 10, 11, 12]


def test_pipeline_drops_near_copies_from_80_percent(spark):
    r = random.Random(3)
    rows, percents = [], set()
    for g in range(20):
        base = [f"g{g}w{i}" for i in range(150)]
        rows.append((2 * g, " ".join(base)))
        for k in (20, 70, 120) if g % 2 else (20, 70, 100, 120):  # windows shared: 81.4 %, 75.3 %
            base[k + r.randint(-3, 3)] = f"e{g}x{k}"
        rows.append((2 * g + 1, " ".join(base)))
        a, b = (brute.shingles(t) for _, t in rows[-2:])
        percents.add(int(100 * len(a & b) / len(a | b)))
    assert percents == {81, 75}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    want = {i for (i, _), c in zip(rows, brute.near_components(rows, 80), strict=True) if i == c}
    assert left == want and len(want) == 30
    assert minhash.near_duplicates(docs).where("kept").count() == 40  # the contract of op6


def test_bands_follow_the_threshold():
    for percent in (80, 85, 90):
        n = minhash.bands_of(percent)
        miss = lambda k: (1 - (percent / 100) ** minhash.ROWS) ** k  # noqa: B023, E731
        assert miss(n) <= minhash.UNMET < miss(n - 1)
    assert minhash.bands_of(85) == 20


def test_merge_dropout_is_drawn_for_each_occurrence():
    """Each occurrence is what one heap gives under its own key; a frequent word gets many segmentations, others under another seed."""
    model = bpe.load(vocabulary("piece_bpe_32k.model"))
    texts = ["internationalisation " * 40 + "é▁" * (k % 3) + " x" * k + "y" * 60 * (k % 2) for k in range(50)]
    seen = []
    for seed in (1, 2):
        keys = kernel.mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(1000 * seed))
        below = int(0.1 * 2**32)
        ids, of = bpe.encode(model, texts, keys, below)
        cut = bpe.Cut(model, texts, literal=True)
        words: dict = {}
        for row in range(len(texts)):
            want, own = [], np.flatnonzero(cut.row == row)
            for ordinal, s in enumerate(own.tolist()):
                a, b = cut.starts[s], cut.starts[s + 1]
                key = kernel.mix(keys[row : row + 1] + np.array([ordinal], np.uint64) * np.uint64(bpe._C3))[0]
                left, at, _ = bpe.merge_one(model, cut.symbols[a:b].tolist(), int(key), below)
                got = []
                for x, i in zip(left, at, strict=True):
                    alone = not x or not model.is_piece[x]
                    got += model.byte_ids[list(chr(cut.points[a + i]).encode())].tolist() if alone else [x]
                words.setdefault(cut.points[a:b].tobytes(), set()).add(tuple(got))
                want += got
            assert ids[of[row] : of[row + 1]].tolist() == want
        seen.append(max(words.values(), key=len))
    assert all(len(x) > 16 for x in seen) and seen[0] != seen[1]


def test_leaks_of_excerpts_and_of_copies_in_parts(spark):
    r = random.Random(12)
    words = lambda n: [" ".join(["".join(r.choice("aeioubcdlmnrst") for _ in range(7))]) for _ in range(n)]
    long, mid = words(250), words(60)
    bench = spark.createDataFrame([(0, " ".join(long)), (1, " ".join(mid))], "item_id long, text string")
    thirds = [mid[:20], words(9), mid[20:40], words(30), mid[40:]]
    texts = [words(50) + long[80:170] + words(50), [w for t in thirds for w in t], words(9) + long[:20] + words(9), words(9) + long[:19] + words(9), mid[40:] + words(9) + mid[20:36]]
    texts += [mid[:18] + words(5) + words(40), words(300)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_windows, x.n_changed) for x in decontaminate.leaks(docs, bench).collect()}
    assert got == {(0, 0): (83, 0), (1, 1): (39, 0), (2, 0): (13, 0), (4, 1): (13, 0)}
    assert sorted(x.doc_id for x in decontaminate.clean(docs, bench).collect()) == [3, 5, 6]
