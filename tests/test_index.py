"""The stored index against plain searches: skipping, deletions, stop words."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import fts, search


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(90_000)]
    rows, at = [], 0
    for i in range(3000):
        n = r.choice([1, 3, 10, 40])
        rows.append((i, i % 7, " ".join(words[at : at + n]), "en" if i % 2 else "sv"))
        at += n
    return spark.createDataFrame(rows[:2990] + [(i, 0, t, "en") for i, t in ((2990, ""), (2991, None), (2992, "W1, w1. w1"))], "doc_id long, chunk_id int, text string, language string").repartition(4)


def _top(df, k, key):
    return [(r[key], round(r._score, 6)) for r in df.orderBy(F.desc(F.round("_score", 6)), key).limit(k).collect()]


def test_the_best_are_those_of_a_full_search(spark, docs, tmp_path):
    index = fts.Index(f"{tmp_path}/i").build(docs, fuzzy=False)
    skipped = 0
    for q, k in (("w1", 5), ("w1 w2 w3", 10), ("w50 w1", 3), ("+w1 +w2 -w3", 10), ("+w7 w1", 5), ("w1 w399 nosuch", 4), ("nosuch", 5), ('"w1 w2"', 5), ("w1 w2", 5000)):
        query = fts.parse(q)
        got = [(r.key, round(r._score, 6)) for r in index.top(spark, query, k).collect()]
        skipped += index.read < index.blocks
        assert got == _top(fts.bm25(docs, query), k, "doc_id"), q
    assert skipped >= 3
    with pytest.raises(ValueError, match="looks for"):
        index.top(spark, fts.parse("-w1"), 5)


def test_engine_from_the_index(spark, docs, tmp_path):
    keys = ["doc_id", "chunk_id"]
    plain, stored = search.Engine(docs, keys), search.Engine(docs, keys, index=fts.Index(f"{tmp_path}/i").build(docs, keys))
    for spec in (search.Spec(q="w1 w20", n=7), search.Spec(q="w1 w2", n=9, filter=search.where(language="sv")), search.Spec(q="w1 w1", n=5, phrase=True), search.Spec(q="w12", n=9, fuzziness=1), search.Spec(q="nosuch"), search.Spec()):
        a, b = ([(r.doc_id, r.chunk_id, round(getattr(r, "_score", 0), 6)) for r in e.search(spec).collect()] for e in (plain, stored))
        assert a == b, spec
    assert stored.search(search.Spec(q="w1", n=3)).columns[:2] == keys


def test_deletions_find_what_distances_find(spark, tmp_path):
    r = random.Random(9)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randrange(1, 13))) for _ in range(900)} | {"a" * 5000, "b", "ab"})
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    index = fts.Index(f"{tmp_path}/i").build(docs)
    for q, d in (("abc", 2), ("a", 1), ("a", 2), ("abcabcabca", 2), ("cécéb", 0), ("cécéb", 2), ("zzzz", 2), ("a" * 5000, 1), ("aab", 1)):
        want = sorted((_distance(q, w), w) for w in words if abs(len(q) - len(w)) <= d and (len(w) < 50 or q == w) and _distance(q[:50], w[:50]) <= d)
        assert index.expand(spark, [q], d) == [w for _, w in want[: fts.EXPANSIONS]], (q, d)
    assert index.expand(spark, [], 2) == [] and set(index.expand(spark, ["abc", "ABC"], 0)) <= {"abc"}


def test_stop_words_keep_the_places_of_others(spark, tmp_path):
    rows = [(1, "rise of the tide"), (2, "rise tide"), (3, "the tide of the rise"), (4, "rise in a tide")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = fts.Index(f"{tmp_path}/i", fts.Analyzer(stop=fts.ENGLISH_STOP)).build(docs)
    find = lambda q: sorted(r.key for r in index.match(spark, fts.parse(q)).collect())
    assert find("tide") == [1, 2, 3, 4] and find('"rise of the tide"') == [1, 4] and find('"the rise tide"') == [2]
    assert {r.term for r in index.vocabulary(spark).collect()} == {"rise", "tide"}
    with pytest.raises(ValueError, match="looks for"):
        index.match(spark, fts.parse("of the"))
    assert search.Engine(docs, ["doc_id"], index=index).search(search.Spec(q="of the")).count() == 0


def test_vocabulary_counts_rows_and_places(spark):
    docs = spark.createDataFrame([("b a b",), ("a",), ("",), (None,), ("A b",)], "text string")
    assert sorted(map(tuple, fts.vocabulary(docs).collect())) == [("a", 3, 3), ("b", 2, 3)]


def test_answers_and_reranking_hooks(spark):
    rows = [(1, "red fox", [1.0, 0.0]), (2, "red red fox den and more words", [0.9, 0.1]), (3, "blue whale", [0.0, 1.0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>")
    longest = search.Reranker(lambda terms: F.length("text").cast("double"))
    engine = search.Engine(docs.drop("embedding"), ["doc_id"], text_vectors=docs.drop("text"), reranker=longest)
    ids = lambda got: [r.doc_id for r in got.collect()]
    near = {"text_vector": [0.0, 1.0], "n": 2, "rerank": True}
    assert ids(engine.search(search.Spec(q="fox", rerank=True))) == [2, 1]
    assert ids(engine.search(search.Spec(q="fox", mode="semantic", **near))) == [2, 3]
    assert ids(engine.search(search.Spec(q="fox", mode="hybrid", **near))) == [2, 3] and engine.search(search.Spec(q="fox", mode="hybrid", **{**near, "n": 5})).count() == 3
    for asked, want in (({"q": "fox"}, 200), ({"q": "fox", "mode": "no"}, 400), ({"q": "x", "mode": "visual", "image_vector": [1.0]}, 503), ({"q": "x", "mode": "semantic"}, 503), ({"mode": "hybrid", "text_vector": [1.0, 0.0]}, 400), ({"q": "fox", "filter": F.col("nothing") == 1}, 400)):
        assert engine.answer(asked)[0] == want, asked
    assert search.LIMITS["shell"] == 10 and search.Spec(q="x", n=search.LIMITS["viewer"]).n == 30
    from tidewater.operators import hits

    docs = spark.createDataFrame([("0123456789abcdef", 1)], "doc_id string, n int")
    assert hits.one_document(docs, "0123456789abcdef").count() == 1 and hits.one_document(docs, "0" * 16).count() == 0
    for bad in ("", None, "0123", "0123456789ABCDEF", "x' or '1'='1"):
        with pytest.raises(ValueError, match="invalid"):
            hits.one_document(docs, bad)


def test_an_index_is_built_without_a_shuffle(spark, tmp_path):
    """Segments are made and sorted where their documents are read; only the vocabulary of the deletions is brought together."""
    words = [f"w{i % 700}" for i in range(1500)]
    rows = [(None, "w1 w2"), (1, " ".join(words)), (2, None), (3, " ".join(words[::-1])), (4, "w511 w512 w513"), *((i, f"w{i} w{i + 1} w1") for i in range(5, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    plans = {}

    class Seen(fts.Index):
        def _store(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
            super()._store(df, name)

    index = Seen(f"{tmp_path}/i").build(docs)
    assert plans == {"postings": 0, "deletions": 1}
    for q in ('"w511 w512 w513"', '+"w1023 w1024"', '"w512 w511"', "w1 w511 -w3"):  # across the pieces of long texts
        got = sorted((str(r.key), round(r._score, 6)) for r in index.match(spark, fts.parse(q)).collect())
        assert got == sorted((str(r.doc_id), round(r._score, 6)) for r in fts.bm25(docs, fts.parse(q)).collect()), q
    assert sorted(index.vocabulary(spark).collect()) == sorted(fts.vocabulary(docs).collect())
