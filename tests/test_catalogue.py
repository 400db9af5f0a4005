"""Every registered query of the engine against its SQL, on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

from tidewater.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def _views(data):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def duck():
    return _views(DATA)


def _rows(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, (int, float, bool)) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", ["bytes_fmt", "bytes_scales", "duration_fmt", "timecode_ms", "event_labels"])
def test_formats_of_more_values(name, spark):
    """Formats whose rows differ only for some values, on the larger tables of the driver's comparison."""
    data = "/root/testdata/sf0.01"
    got = catalogue.queries()[name](spark, data).toPandas()
    assert _rows(got) == _rows(_views(data).sql(catalogue.oracle_sql()[name]).df())


def test_compact_report_counts_the_files_there(spark, tmp_path):
    spark.range(90).withColumnRenamed("id", "doc_id").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalogue.queries()["compact_report"](spark, str(tmp_path)).collect()] == [(3, 90, 1)]
