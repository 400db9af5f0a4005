"""Registered queries over all rows, against plain Python on small fixtures and on the smallest driver tables."""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter

import pytest
from tidewater.plans import catalogue

DATA = "/root/testdata/sf0.001"


def _pieces(pages):
    """page_id -> (md5 of bytes 10 to 99, size); no range, no digest."""
    out = {}
    for i, html in pages:
        data = None if html is None else html.encode()
        out[i] = (hashlib.md5(data[10:100]).hexdigest() if data and len(data) > 10 else None, None if data is None else len(data))
    return out


def test_range_read_takes_every_page(spark, tmp_path):
    pages = [(0, "x" * 200), (1, "é" * 80), (2, "ab€" * 40), (3, "short, clipped"), (4, "0123456789"), (5, ""), (6, None), (7, "a" * 99 + "\U0001f600")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.queries()["range_read"](spark, str(tmp_path)).collect()
    assert {x.page_id: (x.piece_md5, x.size) for x in got} == _pieces(pages) and len(got) == len(pages)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_range_read_of_the_driver_tables(spark):
    pages = [(x.page_id, x.html) for x in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    got = {x.page_id: (x.piece_md5, x.size) for x in catalogue.queries()["range_read"](spark, DATA).collect()}
    assert len(got) == len(pages) and got == _pieces(pages)


def test_query_batch_ranks_by_all_terms(spark, tmp_path):
    docs = [(0, "alpha beta gamma " * 3), (1, "delta epsilon zeta eta theta"), (2, "Alpha delta, epsilon zeta; eta"), (3, "other words only"), (4, "beta theta iota " * 2), (5, ""), (6, "zeta eta theta")]
    items = [(0, "alpha beta gamma delta epsilon zeta eta theta"), (1, "alpha AND missing NOT absent zeta zeta eta"), (2, "nowhere"), (3, "one two three other words")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    avgdl = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    want = {}
    for q, text in items:
        terms = set(re.findall(r"\w+", text.lower())) - {"and", "or", "not", "near"}
        scores = {}
        for i, ws in words.items():
            tf = Counter(ws)
            parts = [math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / avgdl)) for t in terms if tf[t]]
            if parts:
                scores[i] = round(sum(parts), 6)
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5], 1):
            want[q, i] = (s, rank)
    got = {(x.item_id, x.doc_id): (x._score, x["rank"]) for x in catalogue.queries()["fts_query_batch"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_query_batch_is_its_sql_without_the_cut(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    sql = catalogue.oracle_sql()["fts_query_batch"]
    assert sql.count("[1:3]") <= 1
    want = {(r[0], r[1]): r[2:] for r in c.sql(f"select item_id, doc_id, rank, _score from ({sql.replace('[1:3]', '')})").fetchall()}
    got = {(x.item_id, x.doc_id): (x["rank"], x._score) for x in catalogue.queries()["fts_query_batch"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_terms_and_sizes_of_all_rows(spark, tmp_path):
    terms = ["erand", "\u00e9rand", "er\u00e4nd", "\u00e9r\u00e4nd", "\u00e9r\u00e4n\u00f0", "erands", "thth\u00e9r", "th\u00fe\u00e9r", "other", "errands", "\u65e5\u672c"]
    docs = [(0, " ".join(terms), 5), (1, " ".join(terms[:4]), 2048), (2, "x", 1048576), (3, "x", 5 * 1048576 // 2)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.query_term, x.term, x.distance, x.df) for x in catalogue.queries()["fts_fuzzy"](spark, str(tmp_path)).collect()}
    assert got == {(q, t, _edits(q, t), 1 + (t in terms[:4])) for q in ("thther", "erand") for t in terms if _edits(q, t) <= 2}
    sizes = {x.doc_id: x.code for x in catalogue.queries()["bytes_fmt"](spark, str(tmp_path)).collect()}
    assert sizes == {0: "5 B", 1: "2.0 kB", 2: "1.0 MB", 3: "2.5 MB"}
