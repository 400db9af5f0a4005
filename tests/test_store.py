"""Stores, jobs, hits and model clients on small fixtures."""

from __future__ import annotations

import base64
import json
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidewater.functions import media
from tidewater.functions import text as T
from tidewater.operators import embed, fts, hits, ingest, maintain, store, tables
from tidewater.sources import transcripts


def _transcripts(spark, tmp_path, speeches):
    doc = {"audio_path": "m/één.mp4", "sample_rate": 16000, "duration": 9.0, "speeches": speeches}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text(json.dumps(doc))
    return transcripts.read_transcripts(spark, f"{tmp_path}/t")


def test_ingest_driver(spark, tmp_path):
    chunk = {"start": 0, "end": 5, "text": "hej hopp", "language": "sv"}
    align = {"start": 0.0, "end": 5.0, "text": "hej hopp", "words": [{"text": " Hej,", "start": 0.5, "end": 1.0, "score": 0.5}]}
    t = _transcripts(spark, tmp_path, [{"speech_id": "0", "chunks": [chunk, {**chunk, "start": 5, "end": 9}], "alignments": [align]}])
    path = f"{tmp_path}/store"
    for _ in range(2):  # a repeat adds nothing
        assert store.ingest_many(t, path) == 2
    s = store.open_store(spark, path)
    assert s.names == ["chunks"] and len(s.table("chunks").columns) == 26 and s.table("chunks").count() == 2
    store.ingest_many(t, path, base_uri="s3://m")
    s = store.open_store(spark, path, ("chunks", "documents"))
    assert s.table("documents").first().media_blob == "s3://m/één.mp4"
    got = {r.name: (r.n_rows, r.ok) for r in s.health({"up": lambda: True, "down": lambda: 1 / 0}).collect()}
    assert got == {"chunks": (2, True), "documents": (1, True), "up": (None, True), "down": (None, False)}
    with pytest.raises(FileNotFoundError, match="frames"):
        store.open_store(spark, path, ("frames",))
    # hits of the stored chunks
    best = s.table("chunks").withColumn("_score", F.lit(1.0))
    full = hits.full(best).orderBy("chunk_id").collect()
    assert len(full[0]) == 15 and [len(r.alignments) for r in full] == [1, 0]
    assert hits.brief(best).columns == list(hits.BRIEF) and "alignments_json" in hits.brief(best, True).columns
    lines = [r.line for r in hits.listing(best, [F.col("chunk_id")], ["hej"]).orderBy("rank").collect()]
    assert lines[0] == " 1. [00:00→00:05] één.mp4\n     hej hopp\n     • [00:00.500] Hej," and "none of its words" in lines[1]
    joined = hits.lookup(best, s.table("documents")).first()
    assert joined.document.sample_rate == 16000


def test_transcripts_without_chunks_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no chunks"):
        store.ingest_many(_transcripts(spark, tmp_path, [{"chunks": []}]), f"{tmp_path}/store")


def test_columns_and_compaction_in_place(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(100).select("id", F.when(F.col("id") > 5, 1).alias("some")).repartition(9).write.parquet(path)
    assert store.add_column(spark, path, "double", F.col("id") * 2) and not store.add_column(spark, path, "double", F.lit(0))
    assert store.drop_columns(spark, path, ["double", "gone"]) == ["double"] and tables.read(spark, path).columns == ["id", "some"]
    built = []
    got = store.compact(spark, path, 50, {"id": lambda df: built.append(df.count()), "some": lambda df: built.append("no")})
    assert got["rows"] == 100 and got["files_after"] == 2 and (got["rebuilt"], got["skipped"], built) == (["id"], ["some"], [100])
    assert tables.read(spark, path).count() == 100 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_job_resumes_and_drops_empty_results(spark, tmp_path):
    path = f"{tmp_path}/frames"
    todo = spark.range(10).select(F.col("id").alias("k"))
    make = lambda df: df.select("k", F.when(F.col("k") % 3 > 0, F.lit(b"x")).otherwise(F.lit(b"")).alias("jpeg"))
    counts = lambda df: {r.status: r.n for r in df.collect()}
    assert counts(store.run_job(todo.where("k < 6"), make, path, ["k"], "jpeg")) == {"ok": 4, "failed": 2, "skipped": 0}
    assert counts(store.run_job(todo, make, path, ["k"], "jpeg")) == {"ok": 2, "failed": 4, "skipped": 4}
    assert sorted(r.k for r in tables.read(spark, path).collect()) == [1, 2, 4, 5, 7, 8]


def test_merge_and_resolve_do_not_multiply_rows(spark):
    t = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    up = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k int, v string")
    assert sorted(map(tuple, maintain.merge(t, up, ["k"], ["v"]).collect()), key=repr) == [(1, "y"), (2, None)]
    docs = spark.createDataFrame([("in/a.mp4",), ("in/b.mp4",)], "audio_path string")
    files = spark.createDataFrame([("/x/in/a.mp4",), ("file:///x/in/a.mp4",), ("/y/in/a.mp4",), ("/x/b.mp4",)], "path string")
    found, counts = maintain.resolve(docs, files, "/x/")
    assert [r.source for r in found.collect()] == ["/x/in/a.mp4"] and tuple(counts.first()) == (1, 1)
    # a path is taken as it is without a root, and where it is absolute; files of the same name elsewhere are not it
    asked = spark.createDataFrame([("/y/./in//a.mp4", 1), ("a.mp4", 2), (None, 3)], "audio_path string, key int")
    for root in (None, "/x"):
        found, counts = maintain.resolve(asked, files, root)
        assert [(r.source, r.key) for r in found.collect()] == [("/y/in/a.mp4", 1)] and tuple(counts.first()) == (1, 2)


def test_jpeg_markers():
    frame = b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 40, 30) + b"\x01\x01\x11\x00"
    app = b"\xff\xe0\x00\x04ab"
    assert media.jpeg_size(b"\xff\xd8" + app + b"\xff\xd0\xff\xd9" + frame) == (30, 40)
    assert media.jpeg_size(b"\xff\xd8" + app + b"\x00" + frame) == (0, 0)  # no marker where one is due
    assert media.jpeg_size(b"\xff\xd8") == (0, 0) == media.jpeg_size(None)


def test_paths_and_words(spark):
    row = spark.sql("select '/a b/ö*~+%.mp4' as p, array('åbo,', 'bo') as w, cast(null as string) as n")
    got = row.select(media.percent_encoded(F.col("p")), media.mime_or(F.col("n"), "image/jpeg"), T.ascii_word_match(F.col("w"), F.array(F.lit("bo"))), media.confined(F.col("p"), "/a b"), media.confined(F.lit("x/../y"), "/")).first()
    assert tuple(got) == ("/a%20b/%C3%B6%2A~%2B%25.mp4", "image/jpeg", ["åbo,", "bo"], True, False)


def test_index_with_an_analyzer(spark, tmp_path):
    rows = [(1, "Café and walking dogs of the world"), (2, "a cafe walks"), (3, "the dog of walls"), (4, "of the of the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    find = lambda index, q: sorted(r.key for r in index.match(spark, fts.parse(q)).collect())
    plain = fts.Index(f"{tmp_path}/p").build(docs)
    assert find(plain, '"of the"') == [1, 4] and find(plain, "walks") == [2] and find(plain, '+the -"of the"') == [3]
    light = fts.Index(f"{tmp_path}/s", fts.Analyzer(fold=True, stem=True)).build(docs)
    assert find(light, "walked") == [1, 2] and find(light, "café") == [1, 2] and find(light, '"walking dog"') == [1]
    with pytest.raises(ValueError, match="looks for"):
        plain.match(spark, fts.parse("-the"))


def test_search_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, "b c", 6)], "doc_id long, text string, __n int")
    assert [(r.doc_id, r["__n"]) for r in fts.bm25(docs, ["a"]).collect()] == [(1, 5)]


class _Model(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/v1/embeddings":
            content = body["messages"][1]["content"][0]
            given = content.get("text") or base64.b64decode(content["image_url"]["url"].partition(",")[2]).decode()
            out = {"data": [{"embedding": [float(len(given)), 1.0, 9.0]}]}
        else:
            assert body["query"].endswith("<Query>: q\n") and all(d.startswith("<Document>: ") for d in body["documents"])
            scores = [{"index": i, "relevance_score": float(len(d))} for i, d in enumerate(body["documents"])]
            out = {"results": scores[::-1]}
        data = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), _Model)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_model_server(spark, server):
    client = embed.Http(server, dims=2, texts=3)
    unit = lambda n: [n / (n * n + 1) ** 0.5, 1 / (n * n + 1) ** 0.5]
    assert client.embed_text(["a" * n for n in range(1, 9)]) == [pytest.approx(unit(n)) for n in range(1, 9)]
    assert client.embed_image([b"abc"]) == [pytest.approx(unit(3))] and client.embed_text([]) == [] == client.rerank("q", [])
    scores = client.rerank("q", ["aa", "b", "cccc"])
    assert scores[0] - scores[1] == 1 and scores[2] > scores[0]
    with pytest.raises(ValueError, match="too short"):
        embed.Http(server, dims=9).embed_text(["a"])
    docs = spark.createDataFrame([(i, "a" * (i + 1), bytearray(b"x" * (i + 2))) for i in range(20)], "k long, text string, jpeg binary")
    got = {r.k: list(r.embedding) for r in embed.embed(docs, ["k"], "text", backend="http", url=server, dims=2).collect()}
    assert all(got[i] == pytest.approx(unit(i + 1), abs=1e-6) for i in range(20))
    got = {r.k: list(r.embedding) for r in embed.embed(docs, ["k"], "jpeg", backend="http", url=server, dims=2).collect()}
    assert all(got[i] == pytest.approx(unit(i + 2), abs=1e-6) for i in range(20))
