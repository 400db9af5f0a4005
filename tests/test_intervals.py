"""Interval joins against loops over all pairs; keyed append that reads part of the stored table."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import intervals
from tidewater.sources import sinks

BASE = dt.datetime(1969, 12, 31, 23, 0)


def _at(minute):
    return None if minute is None else BASE + dt.timedelta(minutes=minute)


def _cases():
    """Few keys, many ties, intervals from empty to much longer than a bucket, reversed ones, nulls, repeats; times before 1970."""
    r = random.Random(5)
    key = lambda: r.choice(["a", "a", "b", None])
    some = lambda: r.choice([None, *range(0, 300, 5)])
    spans = [(i, key(), s, None if s is None else s + r.choice([-5, 0, 5, 10, 60, 240])) for i in range(60) for s in [some()]]
    return [(i, key(), some()) for i in range(80)], spans + spans[:3], [(i, k, s, e) for i, k, s, e in spans[::2]]


@pytest.mark.parametrize("seconds", [60, 600, 86_400])
def test_interval_joins(spark, seconds):
    times, spans, parts = _cases()
    left = spark.createDataFrame([(i, k, _at(t), 1) for i, k, t in times], "i int, k string, t timestamp, __bucket int")
    right = spark.createDataFrame([(i, k, _at(s), _at(e)) for i, k, s, e in spans], "j int, k string, s timestamp, e timestamp")
    small = spark.createDataFrame([(i, k, _at(s), _at(e)) for i, k, s, e in parts], "i int, k string, a timestamp, b timestamp")
    got = intervals.points(left, right, ["k"], "t", "s", "e", seconds)
    assert "__bucket" in got.columns
    want = [(i, j) for i, k, t in times for j, l, s, e in spans if k == l and None not in (k, t, s) and s <= t < e]
    assert want and sorted((r.i, r.j) for r in got.collect()) == sorted(want)
    got = intervals.inside(small, right, ["k"], "a", "b", "s", "e", seconds)
    want = [(i, j) for i, k, a, b in parts for j, l, s, e in spans if k == l and None not in (k, a, s) and s <= a <= b <= e]
    assert want and sorted((r.i, r.j) for r in got.collect()) == sorted(want)
    assert intervals.points(left.limit(0), right, ["k"], "t", "s", "e").isEmpty()


@pytest.mark.parametrize("kind", ["bigint", "string", "timestamp"])
def test_pruned_append_adds_each_key_once(spark, tmp_path, kind):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "n long").select(F.col("n").cast(kind).alias("k"), "n")
    for ids in ((1, 5, 9), (5, 5, 7), (None, 3, 9), (None,), (20,), (20, 1)):
        sinks.append(rows(*ids), f"{tmp_path}/t", ["k"], prune=True)
    got = sorted((r.n for r in spark.read.parquet(f"{tmp_path}/t").collect()), key=lambda n: (n is None, n or 0))
    assert got == [1, 3, 5, 7, 9, 20, None, None]  # null keys equal nothing
