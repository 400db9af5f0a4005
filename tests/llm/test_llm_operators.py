"""Each operator against a plain version, and on odd tables: nulls, empty and very long texts, repeats, no rows, clashing names."""

from __future__ import annotations

import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontaminate, flatids, kernel, licenses, minhash, pii, quality, tokens, urls, warc
from tidewater.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node int, shard int, start int, label string, __t int"
PIECES, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")


def _texts():
    r = random.Random(5)
    words = ["".join(r.choice(["an", "the", "or", "is", "lo", "ré", "ñu", "ß"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    prose = [" ".join(r.choice(words) for _ in range(r.randint(30, 200))) for _ in range(20)]
    near = prose[0].split()
    near[40:42] = ["quite", "other"]
    odd = ["", "   \n\t", "one", "a b c d", "A B c D", "x" * 20_000, "\n".join(["same line here"] * 50), " ".join(["again and again the same eight words here"] * 10), "# $ % " * 60, "日本語 テキスト　全角", "\x00nul ▁ mark"]
    mail = ["write to a.b+c@mail.example.com or x@y_z@q.org, card 4111 1111 1111 1111; call +1 (555) 123-4567 at 10.0.0.255 not 1.2.3.256", "1.2.3.4.5.6.7.8 " + "7" * 5000 + " a@b.c.@d.e.f " + "1 2 " * 3000, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ok']
    legal = ["Text.\nReleased under the MIT License.\nMIT license", "Licensed under CC BY-NC 4.0.", "the GNU General Public License, Apache License"]
    long = " ".join(r.choice(words) for _ in range(30_000))
    return prose + [" ".join(near), prose[1], prose[1], None, None, long] + odd + mail + legal


def _rows():
    texts = _texts()
    out = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 1, "k", 1, 2, 3, "l", 4) for i, t in enumerate(texts)]
    return [*out, out[2], (None, "null id text of some words here", "en", "s", 1, "k", 1, 2, 3, "l", 4), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _by_text(docs, out, *cols):
    """Values by id where ids are single."""
    return {r.doc_id: tuple(r[c] for c in cols) for r in out.collect() if r.doc_id not in (None, 2)}


def _single():
    return [(r[0], r[1]) for r in _rows() if r[0] not in (None, 2)]


def test_quality(docs, none):
    out = quality.judge(docs)
    got = _by_text(docs, out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in _single():
        want = brute.quality_base(t)
        assert got[i][:5] == want, i
        assert got[i][5] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i][5] and got[i][6])
    assert out.count() == len(_rows())
    assert quality.judge(none).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        words = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 200))]
        rows.append((i, " ".join(w + "###" if i % 10 == 0 else w for w in words), "en", "s"))
    out = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] == (i % 10 != 0) for i in out)


def _least_determinant(y, h, target):
    """The smallest log-determinant over all subsets of h rows, and its centre."""
    import itertools

    factor = quality.consistency(h / len(y))
    made = [(np.linalg.slogdet(factor * np.cov(y[list(c)].T, bias=True) + np.diag(target))[1], c) for c in itertools.combinations(range(len(y)), h)]
    det, best = min(made)
    return det, y[list(best)].mean(axis=0)


@pytest.mark.parametrize("target", [None, list(quality.FEATURES.values())])
def test_mcd_is_the_least_of_all_subsets(spark, target):
    r = np.random.default_rng(3)
    groups = {f"g{g}": np.round(r.normal([1.6, 0.5, 0.1, 0.2], [0.3, 0.4, 0.2, 0.1], (12, 4)) * quality.SCALE).astype(int) for g in range(4)}
    for x in groups.values():
        x[:2] += 3000
    rows = [(g, *map(int, v), 1) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "grp string, x0 long, x1 long, x2 long, x3 long, w long")
    got = {x.grp: x for x in quality.mcd(df, 0.75, starts=60, keep=10, target=target, reweight=None).collect()}
    for g, x in groups.items():
        det, centre = _least_determinant(x / quality.SCALE, 9, np.zeros(4) if target is None else np.array(target) ** 2)
        assert abs(got[g].det - det) < 1e-6 and got[g].n == 9
        assert np.allclose([got[g][f"m{i}"] for i in range(4)], centre, atol=1e-8)


def test_mcd_counts_equal_rows_and_falls_step_by_step(spark):
    """Vectors with their numbers are as many rows; more starts never give a larger determinant; ties share the last places."""
    r = np.random.default_rng(5)
    x = np.round(r.normal(0, 1, (60, 4)) * 3).astype(int) * 300
    flat = [("g", *map(int, v), 1) for v in [*x, *x[:30]]]
    schema = "grp string, x0 long, x1 long, x2 long, x3 long, w long"
    counted = lambda rows: spark.createDataFrame(rows, schema).groupBy("grp", "x0", "x1", "x2", "x3").agg(F.sum("w").alias("w"))
    apart, together = (quality.mcd(df, starts=8).first() for df in (spark.createDataFrame(flat, schema), counted(flat)))
    assert apart.n == together.n > 60 and abs(apart.det - together.det) < 1e-6
    flat = flat[:60]
    few, many = (quality.mcd(counted(flat), starts=k, keep=k, reweight=None).first() for k in (1, 12))
    assert many.det <= few.det and few.n == 45 == many.n
    same = quality.mcd(spark.createDataFrame([("g", 1, 2, 3, 4, 7)], schema), reweight=None).first()
    assert (same.m0, same.m3, same.n) == (0.001, 0.004, 6.0)


def test_small_groups_lean_on_their_language(spark):
    r = random.Random(3)
    text = lambda bad: " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) + "###" * bad for _ in range(100))
    rows = [(i, text(0), "en", "s") for i in range(300)] + [(1000 + i, text(i == 0), "en", f"t{i}") for i in range(20)]
    out = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, k in out.items() if not k] == [1000]


def test_clean_keeps_rows_not_ids(spark, none):
    r = random.Random(4)
    text = " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(5)) for _ in range(80))
    rows = [(1, text, "en", None, "a", 1), (1, "junk", "en", None, "b", 2), (2, None, None, None, None, None), (1, text, "en", None, "a", 1), (None, text, "en", None, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string, __id int")
    out = quality.clean(docs)
    assert out.columns == docs.columns and sorted(x.row for x in out.collect()) == ["a", "a", "c"]
    assert quality.clean(none).count() == 0


def test_near_duplicates(docs, none):
    rows = [(r[0], r[1]) for r in _rows() if r[0] is not None]
    want = brute.near_components(rows)
    out = minhash.near_duplicates(docs.where("doc_id is not null"))
    by = {}
    for (i, t), c in zip(rows, want, strict=True):
        by[i] = (len(brute.shingles(t)), c, i == c)
    for r in out.collect():
        assert (r.n_shingles, r.component_id, r.kept) == by[r.doc_id], r
    assert minhash.near_duplicates(docs).count() == len(_rows())
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Chains and stars of edits, with blocks of a few members."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(1000, " ".join(base))]
    for i in range(80):
        t = list(base)
        for k in r.sample(range(150), r.randint(1, 6)):
            t[k] = f"e{i}x{k}"
        rows.append((i, " ".join(t)))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute.near_components(rows)


def test_dealt_blocks_hold_all_pairs_of_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "WIDE", 1)
    label = {i: 0 if i < 15 else i if i < 23 else 23 for i in range(26)}
    name = lambda i: bytes([i]) * 16
    rows = [(0, 7, name(i), 5, name(k)) for i, k in label.items()] + [(1, 8, name(i), 5, name(0)) for i in range(9)]
    units = {}
    for x in minhash.deal(spark.createDataFrame(rows, "band int, key long, node binary, n_shingles long, label binary")).collect():
        assert x.band == 0
        units.setdefault((x.lo, x.hi), []).append((x.node[0], x.blk))
    met = {(a, b) for (lo, hi), own in units.items() for a, i in own for b, j in own if a < b and (lo == hi or i != j)}
    assert {(a, b) for a in label for b in label if a < b and label[a] != label[b]} <= met
    assert max(map(len, units.values())) < len(label)


def test_bayes_bounds():
    least = minhash.least_matches(0.85, 1e-7)
    assert least == sorted(least)
    assert least[-1] < 0.85 * minhash.K


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_sentencepiece(docs, dropout):
    out = tokens.encode(docs, PIECES, dropout, seed=3, keep=("n_tokens", "ids", "lossless"))
    assert all(r.lossless for r in out.collect())
    back = _by_text(docs, tokens.decode(out.select("doc_id", "ids"), PIECES), "text")
    assert all(back[i][0] == (t or "") for i, t in _single())


def test_sentencepiece_without_dropout_is_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = _by_text(docs, tokens.encode(docs, PIECES, 0.0), "ids")
    assert all(got[i][0] == sp.encode(t or "") for i, t in _single() if "▁" not in (t or ""))


def test_dropout_equals_the_heap():
    """Many segments at once give what one heap and linked list give, candidate by candidate."""
    model, r = bpe.load(PIECES), random.Random(2)
    segments = [[int(model.of_char[ord(c)]) for c in "".join(r.choice("antherios▁é") for _ in range(r.randint(1, 70)))] for _ in range(300)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    keys = kernel.mix(np.arange(300, dtype=np.uint64))
    for below in (0, 1 << 29, 1 << 31):
        sym, merges = bpe.merge_many(model, np.array(sum(segments, [])), starts, keys, below)
        for k, s in enumerate(segments):
            left, _, n = bpe.merge_one(model, s, int(keys[k]), below)
            own = sym[starts[k] : starts[k + 1]]
            assert own[own >= 0].tolist() == left and merges[k] == n


def test_dropout_varies(spark):
    rows = [(i, "international organisations understand " * 8) for i in range(40)]
    out = tokens.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, 0.2, seed=1).collect()
    assert len({tuple(r.ids) for r in out}) > 30 and all(r.lossless for r in out)


def test_token_counts(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = _by_text(docs, tokens.token_counts(docs, PIECES, 100), "n_bytes", "n_tokens", "over_limit")
    for i, t in _single():
        n = len(sp.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 100)
    assert tokens.token_counts(none, PIECES).count() == 0


def test_token_files(docs, none, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    folder = f"file://{tmp_path}/a"
    flatids.write(docs.where("doc_id is not null"), folder, BYTES)
    got = sorted(flatids.read(docs.sparkSession, folder).collect(), key=lambda r: r.start)
    rows = sorted(((r[0], r[1] or "") for r in _rows() if r[0] is not None))
    at = 0
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, (_, t) in zip(got, rows, strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    flatids.write(docs, f"{folder}-n", BYTES)
    assert flatids.read(docs.sparkSession, f"{folder}-n").count() == len(_rows())
    flatids.write(none, f"{folder}-0", BYTES)
    assert flatids.read(docs.sparkSession, f"{folder}-0").count() == 0


def test_pii(docs, none):
    got = _by_text(docs, pii.detect(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in _single():
        want = brute.base_spans(t)
        counts = tuple(sum(k == x for x, _, _ in want) for k in pii.BASE)
        assert got[i][:5] == (*counts, brute.sha(brute.joined(want))), (i, want, got[i])
        assert got[i][5].startswith(brute.joined(want))
    assert pii.detect(none).count() == 0


def test_pii_redacts(spark):
    text = 'é mail a@b.co, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 10.0.0.1.'
    rows = [(i, text, "x") for i in range(30)] + [(99, None, "x"), (98, "plain", "x")]
    out = {r.doc_id: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()}
    assert out[0].text == 'é mail [EMAIL], token = "[SECRET]" and [IP].' and out[0].kept == "x"
    assert out[99].text is None and out[98].text == "plain"


def test_votes_tell_good_labelers_from_bad():
    r = random.Random(4)
    counts: dict = {}
    for _ in range(4000):
        truth = r.random() < 0.4
        v = tuple((1 if truth else -1) if r.random() < acc else (-1 if truth else 1) for acc in (0.95, 0.85, 0.55))
        counts[("secret", *v, 4, 2)] = counts.get(("secret", *v, 4, 2), 0) + 1
    _, rel = pii.aggregate_votes([(*k, n) for k, n in counts.items()])
    assert rel["v_regex"][1][1] > rel["v_gazetteer"][1][1] > rel["v_context"][1][1]


def test_leaks_of_copies_whose_last_slot_runs_on(spark):
    item = "which train goes first from Oslo to Bergen and then late at night goes on all the way from Bergen back to Oslo"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    # the second has two towns for one, but holds most of the item word for word; the third shares its template only
    texts = ["we ask " + item + " Tomorrow we rest", "we ask " + item.replace("Oslo", "Paris", 1), item.replace("Oslo", "Paris", 1).replace("Bergen", "Turku", 2).replace("Turku", "Malmo", 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_changed for x in decontaminate.leaks(docs, bench).collect()}
    assert got == {0: 0, 1: 0}


def test_leaks(spark, none):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(6))
    item = f"If Anna Berg buys 12 apples and {word()} {word()} {word()} sells 12 pears for 30 euros how many {word()} {word()} remain with Anna Berg"
    items = [(1, item), (2, " ".join(word() for _ in range(30))), (3, None), (4, "too short"), (5, "one two three four five six")]
    filler = lambda: " ".join(word() for _ in range(60))
    changed = item.replace("Anna Berg", "Lars").replace("12", "1,700").replace("30 euros", "45 dollars")
    broken = item.replace("Anna Berg buys 12", "Lars buys 7").replace("sells 12", "sells 9")
    texts = [filler() + ". " + item + ". " + filler(), "Then: " + changed + ".", "Then: " + broken + ".", filler(), None, "", items[1][1].upper(), filler() + " " + " ".join(items[1][1].split()[:20]), "one two three four five six", filler() * 200 + items[1][1]]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "k")], "doc_id long, text string, kept string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id, x.n_changed > 0) for x in decontaminate.leaks(docs, bench).collect()]
    assert sorted(got) == [(0, 1, False), (0, 1, False), (1, 1, True), (6, 2, False), (7, 2, False), (8, 5, False), (9, 2, False)]
    assert sorted(x.doc_id for x in decontaminate.clean(docs, bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_equal_brute_force(spark):
    """Random texts over few words, with items whole, cut, changed and re-parameterised in them: one row a document and class."""
    r = random.Random(21)
    words = "red blue kilo mouse when goes home with über ça the a of km dollars Ödön".split()
    names = ["Anna", "Bo Lee", "Élan", "Carl Max Roy", "Dora Eve Fay Gil"]

    def piece(n):
        out = []
        for _ in range(n):
            x = r.random()
            out.append(str(r.randint(1, 40)) if x < 0.12 else r.choice(names) if x < 0.22 else r.choice(words) + (r.choice([".", ",", ";"]) if x > 0.93 else ""))
        return " ".join(out)

    items = [(k, piece(r.choice([1, 2, 4, 6, 8, 9, 12, 20, 40, 70]))) for k in range(30)]
    items += [(100 + k, re.sub("[0-9]+", lambda m: str(int(m[0]) + 50), t)) for k, t in items if k % 3 == 0] + [(200, items[4][1]), (201, None), (None, items[5][1])]
    texts = [None, "", piece(60)]
    for _ in range(70):
        own = r.choice([t for _, t in items[:-2]]).split()
        if r.random() < 0.4:
            own = own[: r.randint(1, len(own))]
        if r.random() < 0.4:
            at = r.randint(0, len(own))
            own[at:at] = piece(r.randint(1, 7)).split()
        if r.random() < 0.4:
            own = re.sub("[0-9]+", lambda m: str(int(m[0]) * 2), " ".join(own)).split()
        texts.append(f"{piece(r.randint(0, 30))} {' '.join(own)} {piece(r.randint(0, 30))}")
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id long")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    known = {x.item_id: x.class_id for x in decontaminate.classes(bench).collect()}
    assert known[200] == known[4] and known[100] == 0 and set(known) == {i for i, _ in items if i is not None}
    units = set(decontaminate.UNITS.split())
    want: dict = {}
    for d, t in enumerate(texts):
        for i, item in items:
            got = brute.leak(t, item, units, decontaminate.ascending, lambda h: decontaminate.runs(h)) if i is not None and item else None
            if got:
                want[d, known[i]] = max(want.get((d, known[i]), 0), got)
    rows = decontaminate.leaks(docs.select("doc_id", "text"), bench).collect()
    got = {(x.doc_id, x.class_id): x.coverage for x in rows}
    assert len(got) == len(rows) and set(got) == set(want), (set(got) ^ set(want))
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all(known[x.item_id] == x.class_id and x.n_items == sum(c == x.class_id for c in known.values()) for x in rows)
    assert sorted(x.doc_id for x in decontaminate.clean(docs, bench).collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})


def test_many_copies_of_one_template_are_one_class(spark):
    items = [(i, f"If Anna buys {i} apples and sells {i + 7} pears at the old market how many does she keep") for i in range(1000, 1600)]
    texts = [f"Now: {items[i][1]}." for i in (3, 3, 8)] + [items[0][1].replace("1000", "17").replace("1007", "24")]
    out = decontaminate.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id, x.class_id, x.n_items, x.n_changed) for x in out) == [(0, 1003, 1000, 600, 0), (1, 1003, 1000, 600, 0), (2, 1008, 1000, 600, 0), (3, 1000, 1000, 600, 2)]


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    r = random.Random(21)
    stem = [f"If {{}} crates of {r.choice(['figs', 'nuts'])} number {k} cost {{}} coins how many coins do four more crates of that kind cost in {{}}" for k in "abcdefgh"]
    items = [(i, stem[i % 8].format(i, i + 5, f"year {i}")) for i in range(200)]
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (None, "nothing")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Some words before. {items[i][1]} And after.") for i in range(0, 200, 9)] + [(999, "clean text")], "doc_id long, text string")
    results = []
    for size in (decontaminate.BLOCK, 100):
        monkeypatch.setattr(decontaminate, "BLOCK", size)
        results.append((sorted(map(tuple, decontaminate.leaks(docs, bench).collect())), sorted(map(tuple, decontaminate.classes(bench).collect()))))
    assert results[0] == results[1] and len({c for _, c in results[0][1]}) >= 8 and len(results[0][0]) >= 20
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.classes(none).count() == 0 == decontaminate.leaks(docs, none).count() and decontaminate.clean(docs, none).count() == docs.count()


def test_token_shards_follow_bytes_and_are_read_in_slices(spark, tmp_path, monkeypatch):
    rows = [(5, "the same words") for _ in range(3000)] + [(i, f"text {i} " * (i % 9)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(flatids, "SHARD", 4000)
    folder = f"file://{tmp_path}/ids"
    manifest = flatids.write(docs, folder, BYTES)
    assert len(manifest["shards"]) > 8 and max(s["docs"] for s in manifest["shards"]) < 1500 and sum(s["docs"] for s in manifest["shards"]) == 3400
    got = sorted(flatids.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    for s in manifest["shards"]:
        a, b = flatids.Shard(folder, s["name"], manifest["width"]), flatids.Shard(folder, s["name"], manifest["width"], ranged=True)
        assert isinstance(b.ids, flatids.Ranged) and len(b.ids) == len(a.ids) == s["tokens"] and len(b.doc_ids) == s["docs"]
        for x, y in ((a.ids, b.ids), (a.of, b.of), (a.doc_ids, b.doc_ids)):
            assert x[2:7].tolist() == y[2:7].tolist() and x[0 : len(x)].tolist() == y[0 : len(y)].tolist()


def _contained(text, percent=80, templates=None):
    """Labels and best score by blocks of the whole text and of each line."""
    best, labels = 0.0, set()
    low = (text or "").translate(brute.LOWER)
    for part in [low, *low.split("\n")]:
        ws = licenses.words_of(part)
        for label, t in templates or licenses.defaults():
            size, own = licenses.size_of(len(t.split())), set(t.split())
            short = len(t.split()) < 10
            for s in range(0, len(ws), size):
                n = len(own & set(ws[s : s + 2 * size]))
                ordered = not short or re.search("(^| )" + " (.* )?".join(t.split()) + "( |$)", " ".join(ws[s : s + 2 * size]))
                if 100 * n >= (100 if short else percent) * len(own) and ordered:
                    labels.add(label)
                    best = max(best, n / len(own))
    return labels, best


def test_licenses(docs, none):
    got = _by_text(docs, licenses.scan(docs), "n_base", "base_labels", "labels", "score")
    for i, t in _single():
        more, best = _contained(t)
        base = set(filter(None, got[i][1].split(",")))
        assert set(filter(None, got[i][2].split(","))) == base | more
        assert abs(got[i][3] - (1.0 if got[i][0] else best)) < 1e-12
    assert licenses.scan(none).count() == 0


def test_short_notices_need_their_own_words_in_order(spark):
    said = {
        "This tool is released under the BSD license.": "", "released under the terms of the GPL; see the license file": "", "Licensed under the MIT license, version 2.0": "mit",
        "Wir arbeiten mit Freude.\nReleased under the zlib license.": "", "Released under the zlib license. Mit Dank an alle": "", "This is released under the\nMIT license": "mit",
        "It is licensed under the Apache License, Version 2.0 (the License)": "apache", "licensed under CC BY-NC 4.0": "cc-by-nc", "Licensed under a Creative Commons Attribution 4.0 license": "cc-by", "released under the old MIT license": "mit",
    }
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {x.doc_id: x.labels for x in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())


def test_license_join_finds_every_block(spark):
    """Blocks of template words at random, near the threshold."""
    r = random.Random(8)
    names = licenses.vocabulary([(label, t) for t, label in licenses.TEMPLATES.items()])
    texts = ["\n".join(" ".join(r.sample(t.split(), max(1, len(t.split()) - r.randint(0, 4))) + r.sample(names, 5)) for t in r.choices(list(licenses.TEMPLATES), k=4)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in licenses.scan(docs).collect():
        more, best = _contained(texts[x.doc_id])
        assert set(filter(None, x.labels.split(","))) == more | set(filter(None, x.base_labels.split(","))) and abs(x.score - (1.0 if x.n_base else best)) < 1e-12


def test_whole_licenses_wrapped_at_80_columns(spark):
    """Whole texts in other text, wrapped, with words changed, against the registered SQL."""
    import textwrap

    import duckdb
    import pandas as pd

    from tidewater.llm.queries import oracle_sql

    r = random.Random(12)
    filler = lambda n: " ".join("".join(r.choice("xyzq") for _ in range(5)) for _ in range(n))
    rows, wanted = [], {}
    for label, t in licenses.TEXTS:
        ws = t.split()
        for share in (0.0, 0.1, 0.5):
            own = [filler(1) if r.random() < share else w for w in ws]
            rows.append((len(rows), "\n".join(textwrap.wrap(f"{filler(r.randint(0, 300))} {' '.join(own)} {filler(r.randint(0, 300))}", 80))))
            if share < 0.5:
                wanted[rows[-1][0]] = label
    rows += [(900, None), (901, ""), (902, "nothing\n")]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(label in got[i].labels.split(",") for i, label in wanted.items())
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = c.sql(oracle_sql()["op10_license_scan"]).df().astype(object).where(lambda f: f.notna(), None)
    assert len(want) == len(got)
    for x in want.itertuples(index=False):
        assert all(got[x.doc_id][k] == getattr(x, k) for k in want.columns if k != "score") and abs(got[x.doc_id].score - x.score) < 1e-12


def test_license_templates_as_a_table_in_parts(spark, monkeypatch):
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    made = [(f"l{k % 30}", " ".join(word() for _ in range(r.randint(1, 120)))) for k in range(60)]
    templates = spark.createDataFrame([*made, made[0], ("none", " , "), ("null", None), (None, "a b")], "label string, text string")
    rows = [(i, f"{' '.join(word() for _ in range(r.randint(0, 90)))}\n{made[i % 60][1]}\n{word()}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for part in (licenses.PART, 500):
        monkeypatch.setattr(licenses, "PART", part)
        for x in licenses.scan(docs, templates=templates).collect():
            more, best = _contained(rows[x.doc_id][1], templates=made)
            assert set(filter(None, x.labels.split(","))) == more and abs(x.score - best) < 1e-12 and f"l{x.doc_id % 60 % 30}" in more
    assert {x.labels for x in licenses.scan(docs, templates=templates.limit(0)).collect()} == {""}


def test_warc(spark, tmp_path):
    import base64
    import hashlib

    rows = [(1, "http://a/1", "same"), (2, None, "same"), (9, "u", "same"), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 50_000), (5, "u", "é" * 50_000), (-(1 << 62), "u", "low"), (1 << 62, "u", "high"), (None, "u", "same"), (None, "u", "lone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, kept string")
    warc.write(pages, f"file://{tmp_path}/w", per_shard=3 * warc.HEADERS, roll=200)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/w").collect()), key=repr)
    b32 = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    canon = {"same": 9, "": 4, "é" * 50_000: 5, "low": -(1 << 62), "high": 1 << 62, "lone": None}
    want, seen = [], set()
    for i, _, t in rows:
        t = t or ""
        first = i == canon[t] and (i, t) not in seen
        seen.add((i, t))
        want.append((i, len(t.encode()), b32(t), "response" if first else "revisit", None if first else canon[t]))
    assert got == sorted(want, key=repr)
    names = sorted(p.name for p in (tmp_path / "w").iterdir())
    first = {n: (tmp_path / "w" / n).read_bytes() for n in names}
    warc.write(pages.repartition(5), f"file://{tmp_path}/v", per_shard=3 * warc.HEADERS, roll=200)
    assert {p.name: p.read_bytes() for p in (tmp_path / "v").iterdir()} == first
    warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0


def test_shard_bounds_refine_crowded_ranges(spark):
    ids = [*range(5000), *(10**15 + 7 * i for i in range(3000)), -5]
    bounds = warc.shard_bounds(spark.createDataFrame([(i, 10) for i in ids], "id long, size long"), 5000)
    sizes = np.bincount(np.searchsorted(bounds, ids, side="right"))
    assert sizes.max() <= 625 and bounds == sorted(bounds)
    assert warc.shard_bounds(spark.createDataFrame([], "id long, size long"), 5000) == []
    # by weight, not by number
    heavy = warc.shard_bounds(spark.createDataFrame([(i, 1000 if i >= 90 else 1) for i in range(100)], "id long, size long"), 2000)
    assert len(heavy) >= 5 and min(heavy) >= 90


def test_warc_files_roll_within_a_shard(spark, tmp_path):
    import json

    r = random.Random(7)
    rows = [(i, f"u{i}", "".join(r.choice("abcdefghijklmnop") for _ in range(2000))) for i in range(300)] + [(1000 + i, "u", "") for i in range(50)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w", per_shard=200_000)
    files = json.loads((tmp_path / "w" / "manifest.json").read_text())["files"]
    shards = [f["shard"] for f in files]
    assert len(set(shards)) > 2 and max(map(shards.count, shards)) > 2
    assert all(f["bytes"] >= 25_000 for f, after in zip(files, files[1:], strict=False) if after["shard"] == f["shard"])
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == 350 and {x.refers_to for x in got if x.record_type == "revisit"} == {1049}


def test_warc_notes_of_digests_that_very_many_rows_have(spark, monkeypatch):
    rows = [(i, f"d{min(i % 7, 3)}") for i in range(100)] + [(100 + i, f"s{i}") for i in range(5)] + [(None, "d0"), (None, "n"), (None, "n")]
    sums = spark.createDataFrame(rows, "id long, sha string")
    top = {d: max((i for i, e in rows if e == d and i is not None), default=None) for _, d in rows}
    want = {(i, d, top[d]) for i, d in rows if i != top[d]}
    for hot in (10, 1000):
        monkeypatch.setattr(warc, "HOT", hot)
        assert {tuple(x) for x in warc.notes_of(sums).collect()} == want


def test_urls(spark):
    assert urls.split_url("HTTPS://A.Example.ORG:80/x/y?z=1#f") == ("a.example.org:80", "/x/y")
    assert urls.split_url("http://Q?x") == ("q", "") and urls.split_url("none") == ("", "") == urls.split_url(None)
    rules = urls.RULES
    for url, rule, verdict in (("http://a.org/", "org/", "allow"), ("http://example.org/es/1", "example.org/es/", "block"), ("http://m.example.org/en/12", "example.org/en/1", "block"), ("http://xcom/fr/", None, None), ("http://a.com/fr/x", "com/fr/", "allow"), ("http://a.org", None, None)):
        assert urls.match_rule(*urls.split_url(url), rules) == (rule, verdict)
    rows = [(i, u, "k") for i, u in enumerate(["http://a.org/1", None, "x", "http://b.com/de/1", "http://c.net/" + "a" * 10_000])] + [(0, "http://a.org/1", "k"), (None, "http://z.net/1", "k")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"))
    assert out.count() == len(rows) and {r.verdict for r in out.collect()} <= {"allow", "block"}
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_trees_learn_held_out_urls(spark):
    r = random.Random(1)

    def make(bad):
        host = "".join(r.choice("abcdefgh0123456789-" if bad else "abcdefghij") for _ in range(r.randint(12, 24) if bad else r.randint(4, 9)))
        query = "?" + "&".join(f"p{k}={r.randint(0, 10**6)}" for k in range(r.randint(2, 5))) if bad and r.random() < 0.7 else ""
        return f"http://{host}.{'xyz' if bad and r.random() < 0.6 else 'com'}/{r.choice(['a', 'b/c', 'news/2'])}{query}"

    truth = [i % 3 == 0 for i in range(3000)]
    made = [make(b) for b in truth]
    labelled = spark.createDataFrame([(u, int(b)) for u, b in list(zip(made, truth, strict=True))[:2000]], "url string, block int")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made) if i >= 2000], "page_id long, url string")
    got = urls.filter_urls(pages, labelled, rules=()).collect()
    assert sum((r.verdict == "block") == truth[r.page_id] for r in got) > 0.95 * len(got)


@pytest.mark.parametrize(("noise", "least"), [(0.0, 0.95), (0.3, 0.85)])
def test_url_trees_learn_within_one_suffix(spark, noise, least):
    r = random.Random(7)
    deep = [r.random() < 0.5 for _ in range(4000)]
    made = [f"http://h{r.randrange(900)}.net/" + "/".join(f"p{r.randrange(50)}" for _ in range(r.randint(3, 6) if d else r.randint(1, 2))) for d in deep]
    given = [int(d != (r.random() < noise)) for d in deep]
    labelled = spark.createDataFrame(list(zip(made, given, strict=True))[:3000], "url string, block int")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made) if i >= 3000], "page_id long, url string")
    got = urls.filter_urls(pages, labelled, rules=()).collect()
    assert sum((x.verdict == "block") == deep[x.page_id] for x in got) > least * len(got) and len({x.block_score for x in got}) > 1


def test_suffix_rates_tell_nothing_about_labels_that_mean_nothing(spark):
    r = random.Random(8)
    rows = [(f"s{r.randrange(60)}", [float(i)], r.randrange(2), 1) for i in range(6000)]
    known = spark.createDataFrame(rows, "suffix string, x array<double>, y int, w long")
    seen = urls.training_rows(known, urls.suffix_sums(known), 0.5).collect()
    assert len(seen) == 6000
    for kind in ("s_rate", "s_n"):
        values = np.array([x[kind] for x in seen])
        y = np.array([x.y for x in seen])
        for cut in np.unique(values)[:-1]:  # no split separates the labels better than chance
            for side in (values <= cut, values > cut):
                assert abs(y[side].mean() - 0.5) < 4 * 0.5 / np.sqrt(side.sum())


def test_url_verdicts_of_repeats_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (2, "http://a.net/x")], "page_id long, url string")
    labelled = spark.createDataFrame([("http://b.net/x", 1), ("http://b.net/x", 0)] * 30, "url string, block int")
    got = [(x.page_id, x.verdict, x.block_score) for x in urls.filter_urls(pages, labelled, rules=()).collect()]
    assert len(got) == 3 and len({g[1:] for g in got}) == 1 and got[0][1] == "allow"  # a score of one half allows


def test_url_features_and_the_sample(spark):
    import math

    import pyarrow as pa

    made = ["http://a.b-c.co.uk/x/y9/?p=1&q=22&&r#f?&z", "", None, "é?x", "http://q/1234567"]
    parts = [urls.split_url(u) for u in made]
    x = urls.lexical(pa.array(made, pa.string()), [h for h, _ in parts], [p for _, p in parts])
    for u, (host, path), row in zip(made, parts, x, strict=True):
        data = (u or "").encode()
        shares = [data.count(c) / len(data) for c in set(data)]
        assert abs(row[5] - sum(-p * math.log2(p) for p in shares)) < 1e-8 and row[0] == len(data)
        assert row[4] == (sum(48 <= c <= 57 for c in data) / len(data) if data else 0) and row[8] == data.count(b"-")
    assert x[0].tolist()[1:4] == [len("a.b-c.co.uk"), len("/x/y9/"), 2] and x[0][6] == 3 and x[0][7] == 4 and x[4][9] == 7
    assert [urls.suffix(h) for h in ("a.b.co.uk", "co.uk", "x.com", "", "x.yy.uk:80")] == ["co.uk", "uk", "com", "", "uk"]
    # rows under the threshold are a few more than the sample, whatever the table's size, and equal rows count as one
    for n in (5_000, 50_000):
        ids = spark.range(n).select(F.xxhash64("id").alias("h"))
        assert 1000 <= ids.where(urls._below(F.col("h"), n, 1000)).count() <= 1600
    assert spark.range(9).where(urls._below(F.col("id"), 9, 1000)).count() == 9


def test_trees_take_numbers_of_rows():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3)).round(1)
    y = (x[:, 0] + x[:, 1] > 0.3).astype(float)
    w = r.integers(1, 4, 300)
    one, two = urls.Trees(rounds=5).fit(x, y, w.astype(float)), urls.Trees(rounds=5)
    rep = np.repeat(np.arange(300), w)
    two.fit(x[rep], y[rep])
    assert one.base == pytest.approx(two.base) and ((one.predict(x) > 0.5) == (y > 0)).mean() > 0.9
