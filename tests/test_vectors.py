"""Batch and compressed vector search against brute force."""

from __future__ import annotations

import os

import numpy as np
import pytest

from tidewater.operators import quantise, vector


@pytest.fixture(scope="module")
def some(spark):
    x = np.random.default_rng(3).normal(size=(400, 16))
    x[200:220] = x[10]  # ties
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)


def _exact(x, q, k):
    x, q = np.float32(x).astype(float), np.float32(q).astype(float)
    d = np.round(1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), 5)
    return np.lexsort((np.arange(len(x)), d))[:k].tolist()


def _found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("size", [1024, 3])
def test_batch_knn_in_blocks(some, size, monkeypatch):
    x, df = some
    monkeypatch.setattr(vector.stored_blocks, "__defaults__", (size,))
    q = df.where("vec_id % 20 = 0 or vec_id = 10").selectExpr("vec_id as query_id", "embedding as query")
    got = _found(vector.batch_knn(df, q, 5))
    assert got == {i: _exact(x, x[i], 5) for i in [*range(0, 400, 20), 10]}
    assert vector.batch_knn(df, q.where("query_id < 0"), 5).count() == 0
    assert len(_found(vector.batch_knn(df.where("vec_id < 3"), q, 5))[0]) == 3


@pytest.mark.parametrize("stored", [False, True])
def test_quantised_index(some, stored, tmp_path):
    x, df = some
    q = df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query")
    index = quantise.IVFPQ(cells=12, subvectors=8).build(df, path=f"{tmp_path}/codes" if stored else None)
    assert index.codes.count() == 400
    whole = _found(index.search(q, 5, nprobes=12, refine=80))
    assert whole == {i: _exact(x, x[i], 5) for i in range(0, 400, 20)}  # all cells, all rows ranked again: exact
    part = _found(index.search(q, 5, nprobes=2))
    assert all(len(v) == 5 and v[0] in (i, 10) for i, v in part.items())  # each finds itself
    assert index.search(q.where("query_id < 0"), 5).count() == 0


def test_quantised_index_refuses(spark, some):
    with pytest.raises(ValueError, match="nulls"):
        quantise.IVFPQ(subvectors=1).build(spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>"))
    with pytest.raises(ValueError, match="no vectors"):
        quantise.IVFPQ(subvectors=1).build(some[1].where("vec_id < 0"))
    with pytest.raises(ValueError, match="divide"):
        quantise.IVFPQ(subvectors=3).build(some[1])


def test_recall_with_a_quarter_of_the_cells(spark, tmp_path):
    r = np.random.default_rng(5)
    middle = r.normal(size=(40, 32)) * 4
    x = middle[r.integers(0, 40, 6000)] + r.normal(size=(6000, 32)) * 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    q = df.where("vec_id % 60 = 0").selectExpr("vec_id as query_id", "embedding as query")
    index = quantise.IVFPQ(cells=32, subvectors=32, sample=3000, rounds=4).build(df, path=f"{tmp_path}/codes")
    got, want = _found(index.search(q, 10, nprobes=8, refine=8)), _found(vector.batch_knn(df, q, 10))
    assert len(want) == 100 and np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.95


def test_vectors_are_held_in_bounded_pieces(some):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array([[1.0, 2.0]] * 20_000)], names=["k", "v"])
    pieces = list(vector.held(iter([batch, batch]), 100_000))
    assert sum(len(k) for p in pieces for k, _ in p) == 40_000 and all(sum(v.nbytes for _, v in p) <= 300_000 for p in pieces)
    q, key, d = vector.keep_best([(np.array([0, 0, 1]), np.array([5, 6, 7]), np.array([0.2, 0.1, 0.3])), (np.array([0]), np.array([4]), np.array([0.1]))], 2)
    assert (q.tolist(), key.tolist(), d.tolist()) == ([0, 0, 1], [4, 6, 7], [0.1, 0.1, 0.3])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no driver tables here")
def test_recall_of_the_registered_query(spark):
    from tidewater.plans import catalogue

    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query")
    got, want = (_found(x) for x in (catalogue.queries()["vec_ivf_pq_knn"](spark, sf), vector.batch_knn(e, q, 10)))
    recall = np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want])
    assert recall >= 0.9, recall
