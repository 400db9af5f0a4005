"""Tables of listed files, byte ranges, language jobs, resumed stages and replaced previews."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidewater.operators import language, maintain, stages, store, tables
from tidewater.operators.commits import Conflict
from tidewater.sources import ranges, sinks
from tidewater.streaming import previews, windows


def _table(spark, tmp_path, n=2000, files=20, **options):
    t = tables.Table(spark, f"{tmp_path}/t", ["k"], **options)
    t.append(spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.concat(F.lit("p/"), F.col("id")).alias("path")), "first", files=files)
    return t


def _rows(t):
    return {r.k: r.v for r in t.frame().collect()}


def test_merge_rewrites_only_files_with_a_match(spark, tmp_path):
    t = _table(spark, tmp_path)
    assert len(t.files()) == 20
    before = set(t.files())
    up = spark.createDataFrame([(k, -k) for k in range(100, 120)] + [(10**6, 1), (None, 2)], "k long, v long")
    counts = t.merge(up, ["v"])
    assert counts["files"] == 20 and 1 <= counts["rewritten"] <= 2 and len(before & set(t.files())) >= 18
    assert _rows(t) == {k: -k if 100 <= k < 120 else 10 * k for k in range(2000)}
    assert t.merge(up.where("k > 5000"), ["v"])["rewritten"] == 0
    # many updates go by ranges alone, and still touch only what they match
    assert t.merge(spark.range(500, 1600).selectExpr("id as k", "0L as v"), ["v"])["rewritten"] < 14


def test_lookup_opens_few_files(spark, tmp_path):
    t = tables.Table(spark, f"{tmp_path}/t", indexed=["doc", "path"])
    rows = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("doc"), F.concat(F.lit("in/"), F.col("id"), F.lit(".mp4")).alias("path"), "id")
    t.append(rows.repartition(24, F.xxhash64("id")))
    assert len(t.files()) == 24
    for column, value in (("path", "in/77.mp4"), ("path", "in/4999.mp4")):
        assert len(t.candidates(column, [value])) <= 3
        assert [r.path for r in t.lookup(column, [value]).collect()] == [value]
    assert len(t.lookup("path", ["in/77.mp4"]).inputFiles()) <= 3
    assert len(t.candidates("path", ["in/none.mp4"])) <= 3 and t.lookup("path", ["in/none.mp4"]).count() == 0 == t.lookup("doc", [None]).count()
    # no value that is there is missed
    every = [r.path for r in rows.where("id % 50 = 0").select("path").collect()]
    assert t.lookup("path", every).count() == 100


def test_append_counts_once(spark, tmp_path):
    t = tables.Table(spark, f"{tmp_path}/t", ["k"])
    first = spark.range(100).selectExpr("id as k", "id as v")
    assert t.append(first, "a") == 100 and t.append(first, "a") == 0
    assert t.append(spark.range(90, 130).selectExpr("id as k", "id as v"), "b") == 30 and t.frame().count() == 130
    # a run that is lost between writing and its entry leaves nothing that readers see
    def lost(*_):
        raise RuntimeError("lost")

    commit, t.log.commit = t.log.commit, lost
    with pytest.raises(RuntimeError):
        t.append(spark.range(500, 600).selectExpr("id as k", "id as v"), "c")
    t.log.commit = commit
    assert tables.read(spark, t.path).count() == 130
    assert t.append(spark.range(500, 600).selectExpr("id as k", "id as v"), "c") == 100 and t.vacuum() > 0 and tables.read(spark, t.path).count() == 230
    # two writers that build on one state: the second one is told
    other, number = tables.Table(spark, t.path, ["k"]), t.state()[0]
    t.append(spark.range(700, 701).selectExpr("id as k", "id as v"))
    with pytest.raises(Conflict):
        other.log.commit({"batch": "x", "add": [], "remove": []}, number)


def test_replacing_a_table_is_one_step(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)
    monkeypatch.setattr(tables.Table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")) if a[1] == "replace" else tables.Log.commit(a[0].log, {"batch": a[2], "op": a[1], "add": a[3], "remove": a[4], "schema": a[6].json()}, a[5]))
    with pytest.raises(RuntimeError):
        store.replace_table(spark.range(5), path)
    assert tables.read(spark, path).count() == 10
    monkeypatch.undo()
    store.replace_table(tables.read(spark, path).withColumn("more", F.lit(1)), path)
    assert tables.read(spark, path).columns == ["id", "more"] and tables.read(spark, path).count() == 10
    os.makedirs(f"{tmp_path}/u/x=1")
    with pytest.raises(ValueError, match="folders of its own"):
        tables.Table(spark, f"{tmp_path}/u").append(spark.range(1))


def test_relabel_touches_two_partitions(spark, tmp_path):
    t = tables.Table(spark, f"{tmp_path}/t", ["k"], partition="lang")
    langs = F.element_at(F.array(*(F.lit(x) for x in ("sv", "en", "f r", "é%"))), (F.col("id") % 4 + 1).cast("int"))
    t.append(spark.range(400).select(F.col("id").alias("k"), langs.alias("lang"), F.col("id").alias("label")), files=3)
    before = set(t.files())
    moved = spark.createDataFrame([(0, "en"), (4, "en"), (1, "en"), (10**6, "sv")], "k long, lang string")
    t.relabel(moved)
    now, want = {r.k: r.lang for r in t.frame().collect()}, {k: ("sv", "en", "f r", "é%")[k % 4] for k in range(400)} | {0: "en", 4: "en"}
    assert now == want
    gone = before - set(t.files())
    assert gone and all("part=sv" in f for f in gone)
    assert t.compact(100)["rewritten"] > 2 and {r.k: r.lang for r in t.frame().collect()} == want


def test_empty_and_clashing_tables(spark, tmp_path):
    t = tables.Table(spark, f"{tmp_path}/t", ["file"], partition="part")
    rows = spark.createDataFrame([("a", 1, "x"), ("b", None, "y")], "file string, n int, part string")
    assert t.append(rows.limit(0)) == 0 and t.frame().count() == 0 and t.frame().columns == ["file", "n", "part"]
    assert t.append(rows) == 2
    t.merge(spark.createDataFrame([("a", 5)], "file string, n int"), ["n"])
    assert sorted(map(tuple, t.frame().collect())) == [("a", 5, "x"), ("b", None, "y")]
    assert maintain.merge(spark.createDataFrame([(1, "o", None)], "k int, new string, v string"), spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], ["v"]).first() == (1, "o", "x")
    with pytest.raises(FileNotFoundError):
        tables.Table(spark, f"{tmp_path}/none").frame()


def test_frame_job(spark, tmp_path):
    chunks = spark.createDataFrame([("d", 0, i, f"{i % 3}.mp4", float(i)) for i in range(9)], "doc_id string, speech_id int, chunk_id int, audio_path string, start double")
    files = spark.createDataFrame([("/in/0.mp4",), ("/in/1.mp4",), ("/other/2.mp4",)], "path string")
    make = lambda rows: rows.select(*store.KEYS, F.when(F.col("chunk_id") > 0, F.encode("source", "UTF-8")).alias("frame_blob"))
    job = lambda **o: {r.status: r.n for r in store.frame_job(chunks, files, make, f"{tmp_path}/frames", "/in", **o).collect()}
    assert job(limit=2) == {"ok": 1, "failed": 1, "missing": 0, "skipped": 0}
    assert job() == {"ok": 4, "failed": 1, "missing": 3, "skipped": 1}
    assert job(everything=True) == {"ok": 5, "failed": 1, "missing": 3, "skipped": 0}
    assert tables.read(spark, f"{tmp_path}/frames").count() == 10  # with everything, keys come twice


def test_byte_ranges(spark, tmp_path):
    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.seek(700 << 20)
        f.write(b"middle" * 10)
        f.truncate(1 << 30)
    got = ranges.read_blob(spark, str(big), 700 << 20, (700 << 20) + (1 << 20), 1 << 18)
    assert got.rdd.getNumPartitions() == 4 and got.select(F.sum(F.length("data"))).first()[0] == 1 << 20
    assert bytes(got.orderBy("start").first().data[:12]) == b"middlemiddle"
    asked = spark.createDataFrame([(str(big), 700 << 20, 6, "a"), (str(big), (1 << 30) - 2, 9, "b"), (str(big), 1 << 31, 5, "c"), (None, 0, 5, "d"), (str(big), 0, 0, "e")], "path string, start long, length long, data string")
    out = {r["data"]: r["bytes"] for r in ranges.read_ranges(asked, data="bytes").collect()}
    assert out == {"a": b"middle", "b": b"\0\0", "c": b"", "d": None, "e": b""}
    rows = spark.createDataFrame([(i, bytes([i]) * i if i else None) for i in range(50)], "k long, c binary").repartition(3)
    places = ranges.store_blobs(rows, "k", "c", f"file://{tmp_path}/blobs")
    assert {r.k: r.data and bytes(r.data) for r in ranges.read_ranges(places).collect()} == {i: bytes([i]) * i if i else None for i in range(50)}


def test_language_job(spark, tmp_path):
    for name in ("a.mp4", "b.mp4", "c.mp4", "d.mp4"):
        (tmp_path / name).write_text(name)
    sound = {"a.mp4": {60.0: ("swe", 0.5), 180.0: ("eng", 0.4), 300.0: ("eng", 0.4)}, "b.mp4": {60.0: ("xx", 0.3), 180.0: ("swe", 0.3)}, "c.mp4": {}, "d.mp4": {60.0: ("bad", 0)}}

    def clip(path, start, seconds):
        name = path.rpartition("/")[2]
        if name == "c.mp4":
            raise OSError("no file")
        return [sound[name][start]] if start in sound[name] else []

    def probe(piece):
        if piece[0][0] == "bad":
            raise ValueError("no voice")
        return piece[0]

    files = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in (*sound, "a.mp4")], "path string")
    heard = language.detect(files, probe, clip)
    got = {r.path.rpartition("/")[2]: (r.status, r.language, r.probability and round(r.probability, 6), r.error) for r in heard.collect()}
    assert got == {"a.mp4": ("ok", "en", 0.266667, None), "b.mp4": ("ok", "xx", 0.1, None), "c.mp4": ("failed", None, None, "no file"), "d.mp4": ("failed", None, None, "no voice")}
    planned = language.moves(heard, str(tmp_path))
    assert (tmp_path / "a.mp4").exists()  # planning moves nothing
    assert {r.path[-5:]: r.status for r in language.move(planned).collect()} == {"a.mp4": "moved", "b.mp4": "moved"}
    assert (tmp_path / "en" / "a.mp4").read_text() == "a.mp4" and not (tmp_path / "a.mp4").exists()
    assert {r.status for r in language.move(planned).collect()} == {"there"}
    (tmp_path / "a.mp4").write_text("again")
    assert sorted(r.status for r in language.move(planned).collect()) == ["failed", "there"]


def test_stages_resume(spark, tmp_path):
    source, root, log = f"{tmp_path}/in", f"{tmp_path}/out", []
    spark.range(10).write.parquet(source)

    def stage(name, needs, f, **more):
        return stages.Stage(name, lambda s, i, p: log.append(name) or f(i, p), needs, **more)

    def chain(least=0, fail=False):
        def last(i, p):
            if fail:
                raise RuntimeError("stopped")
            return i["some"].join(i["twice"], "id")

        return [stage("some", ("in",), lambda i, p: i["in"].where(F.col("id") >= p["least"]), params={"least": least}), stage("twice", ("in",), lambda i, p: i["in"].withColumn("t", F.col("id") * 2)), stage("last", ("some", "twice"), last)]

    with pytest.raises(RuntimeError):
        stages.run(spark, root, chain(fail=True), {"in": source})
    frames, ran = stages.run(spark, root, chain(), {"in": source})
    assert ran == ["last"] and log == ["some", "twice", "last", "last"] and frames["last"].count() == 10
    assert stages.run(spark, root, chain(), {"in": source})[1] == []
    frames, ran = stages.run(spark, root, chain(5), {"in": source})
    assert ran == ["some", "last"] and frames["last"].count() == 5
    spark.range(1).write.mode("append").parquet(source)
    assert stages.run(spark, root, chain(5), {"in": source})[1] == ["some", "twice", "last"]
    with pytest.raises(ValueError, match="before it"):
        stages.run(spark, root, chain()[2:], {"in": source})


def test_previews_and_the_final_pass(spark, tmp_path):
    rows = lambda *secs: spark.createDataFrame([(s, 1.0) for s in secs], "s long, value double").select(F.timestamp_seconds("s").alias("ts"), "value").coalesce(1)
    source, out, point = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/point"
    now = lambda: {int(r.start.timestamp()): (r.n, r.preview_final) for r in previews.current(spark, out, ["start"]).collect()}

    def step(*secs):
        rows(*secs).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, value double").parquet(source)
        previews.previews(windows.tumbling(stream, late="10 seconds"), out, point).awaitTermination()
        return now()

    assert step(0, 1, 31) == {0: (2, False), 30: (1, False)}
    assert step(35, 25, 100) == {0: (3, False), 30: (2, False), 90: (1, False)}  # later results replace earlier ones
    assert step(2, 101)[0] == (3, False)  # behind the watermark: no preview changes
    assert step(102)[90] == (3, False)
    previews.finish(windows.tumbling(spark.read.parquet(source)), out)
    want = {int(r.start.timestamp()): (r.n, True) for r in windows.tumbling(spark.read.parquet(source)).collect()}
    assert now() == want and want[0] == (4, True)


def test_stream_append_is_one_commit_a_batch(spark, tmp_path):
    spark.range(20).selectExpr("id as k").write.parquet(f"{tmp_path}/in")
    for turn in range(2):
        stream = spark.readStream.schema("k long").parquet(f"{tmp_path}/in")
        sinks.append_stream(stream, f"{tmp_path}/t", f"{tmp_path}/point{turn}", ["k"]).awaitTermination()
    t = tables.Table(spark, f"{tmp_path}/t")
    assert t.frame().count() == 20 and len(t.log.entries()) == 2
