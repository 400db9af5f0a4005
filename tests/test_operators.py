"""Ingest, search, fusion and maintenance on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import embed, fts, fusion, ingest, maintain, search, vector
from tidewater.sources import sinks, transcripts
from tidewater.streaming import windows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "sv" / "alignments").mkdir(parents=True)
    word = {"text": "hej", "start": 0.0, "end": 1.0, "score": 0.5}
    align = lambda a, b: {"start": a, "end": b, "text": "t", "words": [word]}
    speech = {"speech_id": None, "chunks": [{"start": 0, "end": 5, "text": None, "language": ""}, {"start": 5, "end": 9, "text": "b", "language": "en"}], "alignments": [align(0, 5), align(4, 6), align(5, 5), align(5, 9)]}
    docs = [{"audio_path": "x/one.mp4", "sample_rate": 16000, "duration": 9.0, "speeches": [speech, {"speech_id": "7", "chunks": []}]}, {"audio_path": "two.mp3", "sample_rate": 8000, "duration": 1.0, "speeches": None}]
    for i, d in enumerate(docs):
        (root / "sv" / "alignments" / f"{i}.json").write_text(json.dumps(d, indent=1))
    (root / "meta.csv").write_text("referenskod;namn;extraid;bildid\n r1 ; A ;;one\nr2;B;e;one\nr3;C;f; \n")
    return root


def test_ingest(spark, corpus):
    t = transcripts.read_transcripts(spark, f"{corpus}/sv/alignments")
    meta = transcripts.read_metadata(spark, f"{corpus}/meta.csv")
    assert [tuple(r) for r in meta.collect()] == [("r2", "B", "e", "one")]
    assert transcripts.document_language(t) == "sv"
    rows = ingest.flatten(t, meta, "sv").orderBy("chunk_id").collect()
    assert [(r.speech_id, r.chunk_id, r.text, r.language, r.namn) for r in rows] == [(0, 0, "", "sv", "B"), (0, 1, "b", "en", "B")]
    # closed on both ends: the crossing one is in neither, the one of no length in both
    assert [[(a["start"], a["end"]) for a in json.loads(r.alignments_json)] for r in rows] == [[(0.0, 5.0), (5.0, 5.0)], [(5.0, 5.0), (5.0, 9.0)]]
    docs = ingest.documents(t, meta, base_uri="s3://m/").orderBy("audio_path").collect()
    assert [(d.media_blob, d.media_mime, d.namn) for d in docs] == [("s3://m/two.mp3", "audio/mpeg", None), ("s3://m/one.mp4", "video/mp4", "B")]


def test_missing_field_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"audio_path": "x", "duration": 1}')
    with pytest.raises(Exception, match="required field"):
        transcripts.read_transcripts(spark, str(tmp_path)).select("audio_path").collect()


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("d1", 0, 0, "it was the best of times", "en", "A1"), ("d1", 0, 1, "the spring of hope", "en", "A1"), ("d2", 0, 0, "hope of spring and wisdom", "sv", "B_1"), ("d2", 1, 0, "foolishness", "sv", "B%1")]
    return spark.createDataFrame(rows, "doc_id string, speech_id int, chunk_id int, text string, language string, namn string")


KEYS = ["doc_id", "speech_id", "chunk_id"]


def _keys(df):
    return [tuple(r[k] for k in KEYS) for r in df.collect()]


def test_queries(chunks, spark, tmp_path):
    q = lambda s: sorted(_keys(fts.bm25(chunks, fts.parse(s))))
    assert q('"spring of hope"') == [("d1", 0, 1)]
    assert q("wisdom OR foolishness") == [("d2", 0, 0), ("d2", 1, 0)]
    assert q("+hope -wisdom") == [("d1", 0, 1)] == q("hope NOT wisdom")
    assert q("spring AND the") == [("d1", 0, 1)]
    near = fts.expand(fts.vocabulary(chunks), ["hops"], 1)
    assert near == ["hope"]
    index = fts.Index(f"{tmp_path}/index").build(chunks.withColumn("key", F.concat_ws("/", *KEYS)), key="key")
    a = {r.key: round(r._score, 9) for r in index.match(spark, ["hope", "the"]).collect()}
    b = {"/".join(map(str, (r.doc_id, r.speech_id, r.chunk_id))): round(r._score, 9) for r in fts.bm25(chunks, ["hope", "the"]).collect()}
    assert a == b


def test_phrase_frequencies(spark):
    df = spark.sql("select split('a a a b a b c a b', ' ') as t")
    got = df.select(*(fts.frequency(F.col("t"), u).alias(str(i)) for i, u in enumerate([("a", "a"), ("a", "b"), ("a", "b", "c"), ("b", "b"), ("a",), ("x", "a")]))).first()
    assert tuple(got) == (2, 3, 1, 0, 5, 0)


def test_filters(chunks):
    assert search.where(" ") is None
    assert _keys(chunks.where(search.where(namn="_1"))) == [("d1", 0, 0), ("d1", 0, 1), ("d2", 0, 0), ("d2", 1, 0)]
    assert _keys(chunks.where(search.where("sv", namn="%%"))) == [("d2", 0, 0), ("d2", 1, 0)]
    spec = search.Spec(q=" x ", n=101, fuzziness=3, weight=2)
    assert (spec.q, spec.n, spec.fuzziness, spec.weight) == ("x", 100, 2, 1.0)
    with pytest.raises(ValueError, match="mode"):
        search.Spec(mode="none")
    assert [search.mode_of(*x) for x in ((1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1))] == ["fts", "hybrid", "semantic", "visual", "all"]


def test_postfilter_keeps_the_top(chunks):
    best = _keys(fts.search(chunks, ["of"], 2, KEYS))
    kept = _keys(fts.search(chunks, ["of"], 2, KEYS, where=F.col("language") == "sv"))
    assert set(kept) <= set(best)
    plan = fts.search(chunks, ["of"], 2, KEYS, where=F.col("language") == "sv")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("GlobalLimit")


def test_engine(chunks, spark):
    vec = embed.embed(chunks, KEYS, "text", dims=16)
    q = embed.Hashing(16).embed_text(["hope of spring and wisdom"])[0]
    engine = search.Engine(chunks, KEYS, vec, vec)
    assert _keys(engine.search(search.Spec(q="", mode="semantic", n=1, text_vector=q))) == [("d2", 0, 0)]
    assert engine.search(search.Spec(q="")).count() == 0
    by = {m: _keys(engine.search(search.Spec(q="hope spring", mode=m, n=4, text_vector=q))) for m in search.MODES}
    assert all(by.values()) and by["hybrid"][0] == ("d1", 0, 1)
    ends = [_keys(engine.search(search.Spec(q="hope spring", mode="hybrid", n=2, text_vector=q, weight=w)))[:2] for w in (0.0, 1.0)]
    assert ends[0] == _keys(engine.search(search.Spec(q="hope spring", n=2))) and ends[1] == _keys(engine.search(search.Spec(mode="semantic", n=2, text_vector=q)))
    assert "_relevance_score" in engine.search(search.Spec(q="hope", mode="all", n=3, text_vector=q, rerank=True)).columns


def test_rrf(spark):
    make = lambda keys, i: fusion.ranked(spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k string, n int"), i, [F.col("n")])
    a, b, empty = make("xyx", 0), make("yz", 1), make("", 2)
    got = {r.k: r._relevance_score for r in fusion.rrf([a, b, empty], ["k"]).collect()}
    assert got == {"x": round(1 / 60 + 1 / 62, 9), "y": round(1 / 61 + 1 / 60, 9), "z": round(1 / 61, 9)}
    assert got == {r.k: r._relevance_score for r in fusion.rrf([empty, b, a], ["k"]).collect()}
    assert [r.k for r in fusion.best(fusion.rrf([a, b], ["k"]), 2, ["k"]).collect()] == ["y", "x"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r._distance) for r in vector.knn(df, [1.0, 0.0], 5, ["vec_id"]).collect()]
    assert got == [(1, 0.0), (4, 0.29289), (2, None)]
    assert vector.knn(df, None, 5, ["vec_id"]).count() == 0
    cut = df.where("embedding is not null").select(vector.truncate(F.col("embedding"), 2).alias("v")).collect()
    assert cut[1].v == [0.0, 0.0]
    with pytest.raises(Exception, match="too few"):
        df.limit(1).select(vector.truncate(F.col("embedding"), 3)).collect()
    with pytest.raises(ValueError, match="nulls"):
        vector.IVF().build(df)


def test_ivf_with_all_cells_is_exact(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = vector.IVF(8).build(df)
    exact = [r.vec_id for r in vector.knn(df, x[5].tolist(), 20, ["vec_id"]).collect()]
    assert [r.vec_id for r in index.search(x[5].tolist(), 20, ["vec_id"], nprobes=8).collect()] == exact
    part = [r.vec_id for r in index.search(x[5].tolist(), 20, ["vec_id"], nprobes=5).collect()]
    assert len(set(part) & set(exact)) >= 15


def test_maintenance(spark, tmp_path):
    t = spark.createDataFrame([(1, None), (2, "b"), (2, "b")], "k int, v string")
    up = spark.createDataFrame([(1, "x"), (9, "y")], "k int, v string")
    assert sorted(tuple(r) for r in maintain.merge(t, up, ["k"], ["v"]).collect()) == [(1, "x"), (2, "b"), (2, "b")]
    filled = maintain.backfill(t, ["k"], "v", lambda d: d.select("k", F.lit("new").alias("v")))
    assert sorted(tuple(r) for r in filled.collect()) == [(1, "new"), (2, "b"), (2, "b")]
    path = f"{tmp_path}/t"
    for _ in range(2):
        sinks.append(t, path, ["k"])
    assert spark.read.parquet(path).count() == 2
    assert maintain.compact(spark, path, f"{tmp_path}/c", rows=1)["files_after"] == 2
    assert sorted(tuple(r) for r in maintain.missing(t, up, ["k"]).select("k").collect()) == [(2,), (2,)]


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{(i * 7) % 50:02d}:{(i * 13) % 60:02d}", i % 3, float(i)) for i in range(60)]
    batch = spark.createDataFrame(rows, "event_id int, t string, user_id int, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    batch.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/e")
    q = windows.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, windows.tumbling(batch).collect()))


def test_exports(spark):
    df = spark.createDataFrame([(1, None, bytearray(b"x"))], "a int, b string, blob binary")
    assert sinks.json_lines(df, ("blob",)).first().json == '{"a":1,"b":null}'


def test_point_lookup_and_alignments(spark):
    schema = "struct<start:double,end:double>"
    parsed = spark.sql("select '[{\"start\":0,\"end\":2},{\"start\":3,\"end\":4}]' as j, 'no' as bad, cast(null as string) as none")
    got = parsed.select(*(ingest.parse_alignments(F.col(c), schema).alias(c) for c in ("j", "bad", "none"))).first()
    assert len(got.j) == 2 and got.bad == [] and got.none == []
    seg = ingest.parse_alignments(F.col("j"), schema)
    at = parsed.select(*(ingest.point_in_interval(seg, F.lit(t)).alias(str(int(t * 10))) for t in (0.0, 2.0, 3.5))).first()
    assert at[0].start == 0.0 and at[1] is None and at[2].start == 3.0


def test_download_resumes_and_isolates_failures(spark, tmp_path):
    from tidewater.sources import download

    manifest = spark.createDataFrame([("a", "u1"), ("b", "bad"), ("c", "u3")], "name string, url string")
    listing = spark.createDataFrame([("a", 5), ("b", 0)], "name string, length long")

    def opener(url, timeout):
        if url == "bad":
            raise OSError("gone")
        return url.encode()

    got = {r.key: (r.status, r.error) for r in download.fetch(manifest, listing, f"file://{tmp_path}", opener=opener).collect()}
    assert got == {"a": ("skipped", None), "b": ("failed", "gone"), "c": ("ok", None)}
    assert [p.name for p in tmp_path.iterdir()] == ["c"] and (tmp_path / "c").read_bytes() == b"u3"
