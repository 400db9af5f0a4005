"""Registered queries of stored tables, stored indexes, streams that replace their results, and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import fts, language, maintain, search, stages, store, tables, vector
from tidewater.plans.catalogue import _bm25, _DIST, _query, _QV, _TOK, _vector, documents, table, TERMS
from tidewater.sources import ranges
from tidewater.streaming import previews, windows


def _stored(spark, rows, name: str, files: int, keys: list[str], **options) -> tables.Table:
    """A table of about `files` files, sorted by key."""
    made = tables.Table(spark, maintain.work_folder(spark, name), keys, **options)
    made.append(rows, files=files)
    return made


# --- tables of listed files


@_query(
    "merge_touched_files",
    """with m as (select max(doc_id) as m from documents)
select d.doc_id, case when d.doc_id <= m // 100 then -d.n_chars else d.n_chars end as n_chars, true as few_files from documents d, m""",
)
def merge_touched_files(spark, sf_dir):
    """An update of the first hundredth of the keys rewrites less than a tenth of the files."""
    docs = documents(spark, sf_dir).select("doc_id", "n_chars", "text")
    stored = _stored(spark, docs, "merged", 40, ["doc_id"])
    edge = docs.agg(F.max("doc_id")).first()[0] // 100
    counts = stored.merge(docs.where(F.col("doc_id") <= edge).select("doc_id", (-F.col("n_chars")).alias("n_chars")), ["n_chars"])
    few = 0 < counts["rewritten"] < counts["files"] / 10
    return stored.frame().select("doc_id", "n_chars", F.lit(few).alias("few_files"))


@_query("key_index_lookup", "select conv_id, turn, md5(text) as text_md5, true as few_files from conversations where conv_id in (3, 42, 77)")
def key_index_lookup(spark, sf_dir):
    """Rows of three keys; ranges and Bloom filters say which of the files are opened. The rows lie in files by hash, so that ranges tell little."""
    rows = table(spark, sf_dir, "conversations")
    stored = tables.Table(spark, maintain.work_folder(spark, "lookup"), indexed=["conv_id"])
    stored.append(rows.repartition(32, "conv_id"))
    few = len(stored.candidates("conv_id", [3, 42, 77])) <= 3 + len(stored.files()) / 4
    return stored.lookup("conv_id", [3, 42, 77]).select("conv_id", "turn", F.md5("text").alias("text_md5"), F.lit(few).alias("few_files"))


@_query("append_commit_log", "select lang, count(*)::bigint as n, sum(doc_id)::bigint as ids from documents group by lang")
def append_commit_log(spark, sf_dir):
    """Two batches, the second one run twice and overlapping the first, and a run that is lost before its commit."""
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    stored = tables.Table(spark, maintain.work_folder(spark, "appended"), ["doc_id"])
    stored.append(docs.where("doc_id % 3 = 0"), "first")
    for _ in range(2):
        stored.append(docs, "second")
    docs.write.parquet(f"{stored.path}/data/lost")
    return tables.read(spark, stored.path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@_query("relabel_partitions", "select case when doc_id % 50 = 7 and lang = 'de' then 'fr' else lang end as lang, count(*)::bigint as n, sum(doc_id)::bigint as ids, true as others_untouched from documents group by 1")
def relabel_partitions(spark, sf_dir):
    """Rows that move between two partitions: the files of all other partitions stay."""
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    stored = _stored(spark, docs, "labelled", 4, ["doc_id"], partition="lang")
    before = {f for f in stored.files() if "/part=de/" not in f}
    stored.relabel(docs.where("doc_id % 50 = 7 and lang = 'de'").select("doc_id", F.lit("fr").alias("lang")))
    return stored.frame().groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).withColumn("others_untouched", F.lit(before <= set(stored.files())))


@_query("frame_job", "select 'failed' as status, count(*) filter (length(text) % 7 = 0)::bigint as n from conversations where conv_id % 4 > 0 union all select 'missing', count(*)::bigint from conversations where conv_id % 4 = 0 "
    "union all select 'ok', 0::bigint union all select 'skipped', count(*) filter (length(text) % 7 <> 0)::bigint from conversations where conv_id % 4 > 0")  # fmt: skip
def frame_job(spark, sf_dir):
    """Pictures of chunks: resolved, extracted and appended, then run again: what is there is skipped, what failed or has no source is tried again."""
    c = table(spark, sf_dir, "conversations")
    path = F.concat(F.col("conv_id").cast("string"), F.lit(".mp4"))
    chunks = c.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("speech_id"), F.col("turn").alias("chunk_id"), path.alias("audio_path"), (F.col("turn") * 30.0).alias("start"))
    files = c.where("conv_id % 4 > 0").select(F.concat(F.lit("/in/"), path).alias("path")).distinct()
    texts = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), F.when(F.length("text") % 7 > 0, F.encode(F.left("text", F.lit(9)), "UTF-8")).alias("frame_blob"))
    make = lambda rows: rows.join(texts, ["doc_id", "chunk_id"]).select(*store.KEYS, "frame_blob")
    folder = maintain.work_folder(spark, "frames")
    for _ in range(2):
        counts = store.frame_job(chunks, files, make, folder, "/in")
    return counts


@_query("status_keys", "select event_type as status, count(*)::bigint as n, string_agg(event_id::varchar, ',' order by event_id) filter (place <= 20) as first_keys from (select *, row_number() over (partition by event_type order by event_id) as place from events) group by 1")
def status_keys(spark, sf_dir):
    return maintain.status_keys(table(spark, sf_dir, "events"), "event_type", "event_id", 20).select(F.col("event_type").alias("status"), "n", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("first_keys"))


@_query("stages_resumed", "select lang, count(*)::bigint as n, sum(length(text))::bigint as chars, 'long,2' as ran_again from documents where length(text) > 100 group by lang")
def stages_resumed(spark, sf_dir):
    """Three stages over documents; with another bound of the second one, the first is not run again."""
    chain = lambda bound: [
        stages.Stage("sizes", lambda s, i, p: i["documents"].select("lang", F.length("text").cast("long").alias("chars")), ("documents",)),
        stages.Stage("long", lambda s, i, p: i["sizes"].where(F.col("chars") > p["bound"]), ("sizes",), {"bound": bound}),
        stages.Stage("sums", lambda s, i, p: i["long"].groupBy("lang").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")), ("long",)),
    ]
    root, source = maintain.work_folder(spark, "stages"), maintain.work_folder(spark, "source")
    documents(spark, sf_dir).select("lang", "text").write.parquet(source)
    stages.run(spark, root, chain(50), {"documents": source})
    frames, ran = stages.run(spark, root, chain(100), {"documents": source})
    assert stages.run(spark, root, chain(100), {"documents": source})[1] == []
    return frames["sums"].withColumn("ran_again", F.lit(f"{ran[0]},{len(ran)}"))


# --- transcripts to rows


def _transcripts(spark, sf_dir):
    """Conversations as transcripts: a file each, a speech, a chunk of thirty seconds a turn, an alignment within it and one across its end."""
    from tidewater.sources import transcripts

    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    spoken = lambda x, a, b, text: F.struct((x.turn * 30 + a).alias("start"), (x.turn * 30 + b).alias("end"), text.alias("text"))
    chunks = F.transform("t", lambda x: spoken(x, 0, 30, x.text))
    aligned = F.flatten(F.transform("t", lambda x: F.array(spoken(x, 0, 15, F.lit("in")), spoken(x, 20, 40, F.lit("across")))))
    speech = F.to_json(F.struct(F.array(F.struct(F.lit("7").alias("speech_id"), chunks.alias("chunks"), aligned.alias("alignments"))).alias("speeches")))
    speeches = F.from_json(speech, f"speeches array<{transcripts.SPEECH}>").speeches
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".mp4"))
    return c.select(path.alias("audio_path"), F.lit(16000).alias("sample_rate"), (F.size("t") * 30.0).alias("duration"), F.lit(None).cast("string").alias("metadata"), speeches.alias("speeches"))


def _metadata(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "labels").select(text("doc_id").alias("bildid"), text("quality").alias("namn"), text("toxic").alias("extraid"), F.lit(None).cast("string").alias("referenskod"))


@_query(
    "ingest_chunks",
    """select substr(sha1('conv/' || conv_id || '.mp4'), 1, 16) as doc_id, 7 as speech_id, (row_number() over (partition by conv_id order by turn) - 1)::int as chunk_id, (turn * 30)::double as start,
(turn * 30 + 30)::double as "end", 'sv' as language, md5(text) as text_md5, 1 as n_alignments, quality::varchar as namn, 26 as columns from conversations left join labels on doc_id = conv_id""",
)
def ingest_chunks(spark, sf_dir):
    """The 26 columns of a stored chunk; the alignment across a chunk's end belongs to none."""
    from tidewater.operators import ingest
    from tidewater.sources import transcripts

    rows = ingest.chunks(_transcripts(spark, sf_dir), _metadata(spark, sf_dir), "sv")
    found = F.size(ingest.parse_alignments(F.col("alignments_json"), transcripts.ALIGNMENT))
    number = lambda c: F.col(c).cast("double").alias(c)
    return rows.select("doc_id", "speech_id", "chunk_id", number("start"), number("end"), "language", F.md5("text").alias("text_md5"), found.alias("n_alignments"), "namn", F.lit(len(rows.columns)).alias("columns"))


@_query(
    "ingest_documents",
    """select substr(sha1('conv/' || conv_id || '.mp4'), 1, 16) as doc_id, 'video/mp4' as media_mime, 's3://m/' || conv_id || '.mp4' as media_blob, 1 as num_speeches, count(*) * 30.0::double as duration, any_value(quality)::varchar as namn, '{}' as metadata
from conversations left join labels on doc_id = conv_id group by conv_id""",
)
def ingest_documents(spark, sf_dir):
    from tidewater.operators import ingest

    rows = ingest.documents(_transcripts(spark, sf_dir), _metadata(spark, sf_dir), base_uri="s3://m/")
    return rows.select("doc_id", "media_mime", "media_blob", "num_speeches", "duration", "namn", "metadata")


# --- byte ranges


@_query("range_seek", "select page_id, case when strlen(html) > 10 then md5(unhex(substr(hex(encode(html)), 21, 180))) else md5('') end as piece_md5 from pages where html is not null")
def range_seek(spark, sf_dir):
    """Ninety bytes of each page, read by seeking in files that hold many pages each."""
    places = ranges.store_blobs(table(spark, sf_dir, "pages"), "page_id", "html", maintain.work_folder(spark, "blobs"))
    asked = places.where("length is not null").select("page_id", "path", (F.col("start") + 10).alias("start"), F.greatest(F.lit(0), F.least(F.lit(90), F.col("length") - 10)).cast("long").alias("length"))
    return ranges.read_ranges(asked).select("page_id", F.md5("data").alias("piece_md5"))


# --- languages


@_query(
    "language_job",
    f"""with t as (select distinct text from documents), s as (select text, i, substr(text, (10 * [1, 3, 5][i + 1] + 1)::int, 30) as clip from t, range(3) r(i)),
v as (select text, i, case when contains(clip, 'th') then 'eng' when contains(clip, 'ch') then 'ger' else 'xxx' end as label, length(clip) / 30.0::double as p from s where length(clip) > 0 and not contains(clip, 'qu')),
w as (select text, label, sum(p) as p, min(i) as seen from v group by all), b as (select *, row_number() over (partition by text order by p desc, seen) as n from w)
select md5(t.text) as name, case when b.text is null then 'failed' else 'ok' end as status, case label when 'eng' then 'en' when 'ger' then 'de' else label end as language, round(p / 3, 6) as probability from t left join b on b.text = t.text and n = 1""",
)
def language_job(spark, sf_dir):
    """Texts as recordings of one character a second; a probe that raises makes a sample unusable."""

    def clip(text, start, seconds):
        return text[int(start) : int(start + seconds)]

    def probe(piece):
        if "qu" in piece:
            raise ValueError("unclear")
        return "eng" if "th" in piece else "ger" if "ch" in piece else "xxx", len(piece) / 30

    heard = language.detect(documents(spark, sf_dir).where("text is not null"), probe, clip, "text", offset=10.0)
    return heard.select(F.md5("path").alias("name"), "status", "language", F.round("probability", 6).alias("probability"))


# --- streams


@_query("stream_previews", "select time_bucket(interval 30 seconds, ts) as start, count(*)::bigint as n, round(sum(value), 4) as total, true as final, true as replaced from events group by 1")
def stream_previews(spark, sf_dir):
    """Events in disorder over many micro-batches, some behind the watermark: previews replace one another, and the final pass replaces them."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")  # a watermark needs a time zone
    root, size = maintain.work_folder(spark, "previews"), events.count()
    turn = F.pmod(F.xxhash64("event_id"), F.lit(10))  # each batch has events of all times
    events.withColumn("turn", turn).repartition(10, "turn").drop("turn").write.parquet(f"{root}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/events")
    previews.previews(windows.tumbling(stream, late="10 seconds"), f"{root}/windows", f"{root}/checkpoint").awaitTermination()
    early = previews.current(spark, f"{root}/windows", ["start"])
    replaced = size > 0 and early.count() < tables.read(spark, f"{root}/windows").count()
    previews.finish(windows.tumbling(spark.read.schema(events.schema).parquet(f"{root}/events")), f"{root}/windows")
    last = previews.current(spark, f"{root}/windows", ["start"])
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "total", F.col(previews.FINAL).alias("final"), F.lit(replaced).alias("replaced"))


# --- searches of the stored index


def _engine(spark, sf_dir, analyzer: fts.Analyzer | None = None, fuzzy: bool = False) -> search.Engine:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return search.Engine(docs, ["doc_id"], index=fts.Index(maintain.work_folder(spark, "index"), analyzer).build(docs, fuzzy=fuzzy))


@_query("fts_engine_index", f"with {_bm25(TERMS)} select doc_id, lang, round(s, 6) as _score, true as skipped from scored order by round(s, 6) desc, doc_id limit 20")
def fts_engine_index(spark, sf_dir):
    """The engine's search from the stored index; blocks that cannot hold one of the twenty best are not read."""
    engine = _engine(spark, sf_dir)
    found = engine.search(search.Spec(q=" ".join(TERMS), n=20))
    few = engine.index.blocks < 200 or engine.index.read < engine.index.blocks  # on very small tables all blocks are among the first
    return found.select("doc_id", "lang", F.round("_score", 6).alias("_score"), F.lit(few).alias("skipped"))


@_query(
    "fts_engine_fuzzy",
    rf"""with {_TOK}, corpus as (select count(*) as n, avg(len(t)) as avgdl from tok), v as (select distinct term, regexp_replace(term, '[^\x00-\x7F]', '#', 'g') as plain from (select unnest(t) as term from tok)),
near as (select q, term, row_number() over (partition by q order by levenshtein(plain, q), term) as r from v, (values ('thther'), ('erand')) x(q) where levenshtein(plain, q) <= 2),
wanted as (select distinct term from near where r <= 50),
w as (select doc_id, len(t) as dl, unnest(t) as term from tok), tf as (select doc_id, dl, term, count(*) as tf from w where term in (select term from wanted) group by all),
df as (select term, count(*) as df from tf group by term),
s as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as s from tf join df using (term), corpus group by doc_id)
select doc_id, round(s, 6) as _score from s order by round(s, 6) desc, doc_id limit 20""",
)
def fts_engine_fuzzy(spark, sf_dir):
    """Words within two edits of the query's, from the stored deletions; no text is read for it."""
    found = _engine(spark, sf_dir, fuzzy=True).search(search.Spec(q="thther erand", n=20, fuzziness=2))
    return found.select("doc_id", F.round("_score", 6).alias("_score"))


WORDS = ["the", "than", "thing", "with"]
_KEPT = f"kept as (select doc_id, list_filter(t, lambda w: w not in ({', '.join(repr(w) for w in fts.ENGLISH_STOP)})) as t from tok)"


@_query(
    "fts_index_stop_words",
    f"""with {_TOK}, {_KEPT}, corpus as (select count(*) as n, avg(len(t)) as avgdl from kept),
tf as (select doc_id, len(t) as dl, term, len(list_filter(t, lambda x: x = term)) as tf from kept, (values ('than'), ('thing')) q(term)), df as (select term, count(*) as df from tf where tf > 0 group by term)
select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as _score from tf join df using (term), corpus where tf > 0 group by doc_id order by 2 desc, 1 limit 20""",
)
def fts_index_stop_words(spark, sf_dir):
    """An index without stop words: they are no terms of texts or queries, and no part of a text's length."""
    engine = _engine(spark, sf_dir, fts.Analyzer(stop=fts.ENGLISH_STOP))
    return engine.search(search.Spec(q=" ".join(WORDS), n=20)).select("doc_id", F.round("_score", 6).alias("_score"))


# --- modes of the engine

_NEAR = f"near as (select vec_id as doc_id, {_DIST} as d from embeddings, q order by 2, 1 limit 20)"


@_query("search_semantic_engine", f"with {_QV}, {_NEAR} select doc_id, lang, d as _distance from near join documents using (doc_id) where lang in ('en', 'fr')")
def search_semantic_engine(spark, sf_dir):
    """Neighbours of a vector, joined to their texts; the filter applies after ranking."""
    engine = search.Engine(documents(spark, sf_dir), ["doc_id"], text_vectors=table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"))
    spec = search.Spec(n=20, mode="semantic", text_vector=_vector(spark, sf_dir), filter=F.col("lang").isin("en", "fr"))
    return engine.search(spec).select("doc_id", "lang", "_distance")


@_query(
    "search_hybrid_mode",
    f"""with {_QV}, {_NEAR}, {_bm25(TERMS)}, a as (select doc_id, row_number() over (order by s desc, doc_id) - 1 as r, 0 as l from scored qualify r < 20),
b as (select doc_id, row_number() over (order by d, doc_id) - 1 as r, 1 as l from near join documents using (doc_id)),
f as (select doc_id, round(sum(1 / (60 + r)), 9) as s, min((l, r)) as first from (select * from a union all select * from b) group by doc_id)
select doc_id, s as _relevance_score from f order by s desc, first, doc_id limit 20""",
)
def search_hybrid_mode(spark, sf_dir):
    """Words and vector fused by rank."""
    engine = search.Engine(documents(spark, sf_dir), ["doc_id"], text_vectors=table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"))
    return engine.search(search.Spec(q=" ".join(TERMS), n=20, mode="hybrid", text_vector=_vector(spark, sf_dir))).select("doc_id", "_relevance_score")


@_query("vec_ivf_all_cells", f"with {_QV} select vec_id, {_DIST} as _distance from embeddings, q order by 2, 1 limit 20")
def vec_ivf_all_cells(spark, sf_dir):
    """With every cell probed, the inverted file gives the exact neighbours."""
    index = vector.IVF().build(table(spark, sf_dir, "embeddings"))
    return index.search(_vector(spark, sf_dir), 20, ["vec_id"], nprobes=16).select("vec_id", "_distance")


@_query("json_pretty", "select doc_id, md5('{' || chr(10) || '  \"doc_id\" : ' || doc_id || ',' || chr(10) || '  \"n_chars\" : ' || n_chars || chr(10) || '}') as json_md5, md5(trim(text) || chr(10)) as txt_md5 from documents")
def json_pretty(spark, sf_dir):
    from tidewater.sources import sinks

    docs = documents(spark, sf_dir)
    made = docs.select("doc_id", "n_chars", "text")
    lines = sinks.pretty_json(made, ("text",)).select("json", F.get_json_object("json", "$.doc_id").cast("long").alias("doc_id"))
    return lines.join(made.select("doc_id", F.md5(T.to_txt(F.col("text"))).alias("txt_md5")), "doc_id").select("doc_id", F.md5("json").alias("json_md5"), "txt_md5")
