"""The registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import lookup, media
from tidewater.functions import text as T
from tidewater.operators import embed, fts, fusion, hits, ingest, intervals, maintain, quantise, search, store, tables, vector
from tidewater.streaming import windows

TERMS = ["the", "thans", "other"]
MARKED, PLAIN = T.MARKED, T.PLAIN
_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# --- full-text search

_TOK = r"tok as (select doc_id, lang, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as t from documents)"


def _bm25(terms, where: str = "") -> str:
    """CTEs that end in `scored(doc_id, lang, source, _score)`."""
    listed = ", ".join(f"('{t}')" for t in terms)
    return f"""{_TOK}, corpus as (select count(*) as n, avg(len(t)) as avgdl from tok), wanted(term) as (values {listed}),
tf as (select doc_id, lang, source, len(t) as dl, term, len(list_filter(t, lambda x: x = term)) as tf from tok, wanted),
df as (select term, count(*) as df from tf where tf > 0 group by term),
scored as (select doc_id, lang, source, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as s
  from tf join df using (term), corpus where tf > 0 {where} group by all)"""


def _rounded(df: DataFrame, k: int = 20, where=None, prefilter: bool = False) -> DataFrame:
    if where is not None and prefilter:
        df = df.where(where)
    out = df.withColumn("_score", F.round("_score", 6))
    best = fts.top(out, k, "doc_id")
    return (best if where is None or prefilter else best.where(where)).select("doc_id", "_score")


@_query("fts_match", f"with {_bm25(TERMS)}, b as (select * from scored order by round(s, 6) desc, doc_id limit 20) select doc_id, round(s, 6) as _score from b where lang = 'en'")
def fts_match(spark, sf_dir):
    return _rounded(fts.bm25(documents(spark, sf_dir), TERMS), where=F.col("lang") == "en")


@_query("fts_match_postfilter", f"with {_bm25(TERMS)}, b as (select * from scored order by round(s, 6) desc, doc_id limit 20) select doc_id, round(s, 6) as _score from b where source like '%1%'")
def fts_match_postfilter(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("namn", F.col("source"))
    return _rounded(fts.bm25(docs, TERMS), where=search.where(namn="1"))


@_query("fts_match_prefilter", f"with {_bm25(TERMS)} select doc_id, round(s, 6) as _score from scored where source like '%1%' order by round(s, 6) desc, doc_id limit 20")
def fts_match_prefilter(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("namn", F.col("source"))
    return _rounded(fts.bm25(docs, TERMS), where=search.where(namn="1"), prefilter=True)


def _phrase_tf(alias: str, words: list[str]) -> str:
    cond = " and ".join(f"t[i + {k + 1}] = '{w}'" for k, w in enumerate(words))
    return f"len(list_filter(range(len(t)), lambda i: {cond})) as {alias}"


@_query(
    "fts_phrase",
    f"""with {_TOK}, corpus as (select count(*) as n, avg(len(t)) as avgdl from tok),
tf as (select doc_id, len(t) as dl, {_phrase_tf('tf', ['of', 'the'])} from tok), df as (select count(*) as df from tf where tf > 0)
select doc_id, tf::bigint as phrase_tf, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as _score from tf, df, corpus where tf > 0""",
)
def fts_phrase(spark, sf_dir):
    found = fts.bm25(documents(spark, sf_dir), fts.parse('"of the"')).withColumn("t", T.tokens(F.col("text")))
    return found.select("doc_id", fts.frequency(F.col("t"), ("of", "the")).cast("long").alias("phrase_tf"), F.round("_score", 6).alias("_score"))


@_query(
    "fts_fuzzy",
    f"""with {_TOK}, v as (select term, regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g') as plain, count(distinct doc_id) as df from (select doc_id, unnest(t) as term from tok) group by term),
n as (select q, term, levenshtein(plain, q) as d, df, row_number() over (partition by q order by levenshtein(plain, q), term) as r from v, (values ('thther'), ('erand')) x(q)
  where levenshtein(plain, q) <= 2)
select q as query_term, term, d::bigint as distance, df::bigint as df from n where r <= 50""",
)
def fts_fuzzy(spark, sf_dir):
    vocab = fts.vocabulary(documents(spark, sf_dir))
    out = None
    for q in ("thther", "erand"):
        part = vocab.select(F.lit(q).alias("query_term"), "term", F.levenshtein("term", F.lit(q), 2).cast("long").alias("distance"), "df").where("distance >= 0")
        part = part.orderBy("distance", "term").limit(fts.EXPANSIONS)
        out = part if out is None else out.unionAll(part)
    return out


@_query(
    "fts_boolean",
    f"""with {_TOK}, c as (select doc_id, list_contains(t, 'the') as a, list_contains(t, 'with') as b, list_contains(t, 'from') as c from tok) select doc_id from c where a and b and not c""",
)
def fts_boolean(spark, sf_dir):
    return fts.bm25(documents(spark, sf_dir), fts.parse("+the +with -from")).select("doc_id")


_QTERMS = r"(select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w not in ('and', 'or', 'not', 'near'))) as terms from benchmark)"


@_query(
    "fts_query_batch",
    f"""with {_TOK}, corpus as (select count(*) as n, avg(len(t)) as avgdl from tok), q as {_QTERMS},
w as (select doc_id, len(t) as dl, unnest(t) as term from tok), qt as (select item_id, unnest(terms) as term from q),
tf as (select doc_id, dl, term, count(*) as tf from w where term in (select term from qt) group by all), df as (select term, count(*) as df from tf group by term),
s as (select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as s from tf join df using (term) join qt using (term), corpus group by all),
r as (select *, row_number() over (partition by item_id order by s desc, doc_id) as rank from s) select item_id, doc_id, s as _score, rank::bigint as rank from r where rank <= 5""",
)
def fts_query_batch(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select("item_id", T.query_terms_col(F.col("text")).alias("terms"))
    return fts.batch_search(documents(spark, sf_dir), queries, 5).withColumn("rank", F.col("rank").cast("long"))


@_query("fts_fold", f"with {_TOK} select strip_accents(term) as folded, count(*)::bigint as n from (select unnest(t) as term from tok where lang in ('fr', 'de', 'es')) where not regexp_matches(strip_accents(term), '[^a-z]') group by 1")
def fts_fold(spark, sf_dir):
    words = documents(spark, sf_dir).where(F.col("lang").isin("fr", "de", "es")).select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return words.select(T.fold(F.col("term")).alias("folded")).where(~F.col("folded").rlike("[^a-z]")).groupBy("folded").agg(F.count("*").alias("n"))


@_query("fts_stem")
def fts_stem(spark, sf_dir):
    from tidewater.functions import stem

    return stem.stems(fts.vocabulary(documents(spark, sf_dir)), "english").groupBy("stem").agg(F.count("*").alias("n_terms"), F.sum("cf").alias("cf"))


@_query("fts_index_stats", f"with {_TOK} select term, count(distinct doc_id)::bigint as df, count(*)::bigint as cf from (select doc_id, unnest(t) as term from tok) group by term")
def fts_index_stats(spark, sf_dir):
    return fts.vocabulary(documents(spark, sf_dir)).select("term", "df", F.col("cf").cast("long"))


@_query("query_terms", r"select item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w not in ('and', 'or', 'not', 'near')), ' ') as terms from benchmark")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms_col(F.col("text")), " ").alias("terms"))


@_query("word_match", r"""select doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: lower(regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')) in ('the', 'thans', 'other')), '|') as words from documents""")
def word_match(spark, sf_dir):
    terms = F.array(*(F.lit(t) for t in TERMS))
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.word_match(F.split("text", " "), terms), "|").alias("words"))


@_query("highlight", "select doc_id, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(the|amp)', '<mark>\\1</mark>', 'gi')) as html_md5 from documents")
def highlight(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.highlight(F.col("text"), ["the", "amp"])).alias("html_md5"))


@_query("html_escape", "select page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as escaped_md5 from pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped_md5"))


# --- vectors

_QV = "q as (select embedding::double[] as q from embeddings where vec_id = 7)"
_DIST = "round(1 - list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 5) + 0.0"


def _vector(spark, sf_dir, vec_id: int = 7) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


@_query("vec_cosine_topk", f"with {_QV} select vec_id, {_DIST} as _distance from embeddings, q order by 2, 1 limit 20")
def vec_cosine_topk(spark, sf_dir):
    return vector.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20, ["vec_id"]).select("vec_id", "_distance")


@_query("vec_postfilter", f"with {_QV}, b as (select vec_id, label, {_DIST} as _distance from embeddings, q order by 3, 1 limit 50) select vec_id, label, _distance from b where label = 3")
def vec_postfilter(spark, sf_dir):
    return vector.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 50, ["vec_id"], where=F.col("label") == 3).select("vec_id", "label", "_distance")


@_query("vec_mrl_truncate", "with t as (select vec_id, embedding[1:32]::double[] as v from embeddings) select vec_id, array_to_string(list_transform(v, lambda x: (round(x / sqrt(list_dot_product(v, v)) * 10000))::int), ',') as v from t")
def vec_mrl_truncate(spark, sf_dir):
    v = F.transform(vector.truncate(F.col("embedding"), 32), lambda x: F.round(x * 10000).cast("int").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(v, ",").alias("v"))


@_query("vec_ivf_topk")
def vec_ivf_topk(spark, sf_dir):
    index = vector.IVF().build(table(spark, sf_dir, "embeddings"))
    return index.search(_vector(spark, sf_dir), 20, ["vec_id"], nprobes=12).select("vec_id", "_distance")


@_query(
    "vec_batch_knn",
    """with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 20 = 0), d as (select query_id, vec_id, round(1 - list_dot_product(embedding::double[], q) /
(sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 5) + 0.0 as _distance from embeddings, q),
r as (select *, row_number() over (partition by query_id order by _distance, vec_id) as rank from d) select query_id, vec_id, _distance, rank::bigint as rank from r where rank <= 5""",
)
def vec_batch_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.batch_knn(e, q, 5).withColumn("rank", F.col("rank").cast("long"))


@_query("vec_ivf_pq_knn")
def vec_ivf_pq_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = quantise.IVFPQ(subvectors=32).build(e)
    # a share of the cells, not a number: these vectors hardly cluster, and the share needed for a recall of 0.9 holds at other sizes
    return index.search(q, 10, nprobes=-(-3 * len(index.centres) // 4))


@_query("vec_join_back", f"with {_QV}, b as (select vec_id, {_DIST} as _distance from embeddings, q order by 2, 1 limit 20) select doc_id, lang, source, _distance from b join documents on vec_id = doc_id")
def vec_join_back(spark, sf_dir):
    near = vec_cosine_topk(spark, sf_dir)
    return documents(spark, sf_dir).join(F.broadcast(near), F.col("doc_id") == F.col("vec_id")).select("doc_id", "lang", "source", "_distance")


# --- fusion

_TEXT20 = f"{_bm25(TERMS)}, a as (select doc_id, round(s, 6) as s, row_number() over (order by round(s, 6) desc, doc_id) - 1 as r from scored order by 2 desc, 1 limit 60)"
_VEC20 = f"{_QV}, v as (select vec_id as doc_id, {_DIST} as d from embeddings, q order by 2, 1 limit 60), b as (select doc_id, d, row_number() over (order by d, doc_id) - 1 as r from v)"


def _branches(spark, sf_dir, k: int = 60):
    a = _rounded(fts.bm25(documents(spark, sf_dir), TERMS), k)
    b = vector.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), k, ["vec_id"]).select(F.col("vec_id").alias("doc_id"), "_distance")
    return a, b


@_query(
    "fuse_rrf",
    f"with {_TEXT20}, {_VEC20}, u as (select doc_id, 0 as l, r from a union all select doc_id, 1, r from b), f as (select doc_id, round(sum(1.0 / (60 + r)), 9) as s, min(l * 1000 + r) as o from u group by doc_id) "
    "select doc_id, s as _relevance_score from f order by s desc, o, doc_id limit 20",
)
def fuse_rrf(spark, sf_dir):
    a, b = _branches(spark, sf_dir)
    lists = [fusion.ranked(a, 0, [F.desc("_score"), F.col("doc_id")]), fusion.ranked(b, 1, [F.col("_distance"), F.col("doc_id")])]
    return fusion.best(fusion.rrf(lists, ["doc_id"]), 20, ["doc_id"])


def _collision(strict: bool) -> str:
    key = "conv_id, turn, role" if strict else "conv_id, turn"
    return f"""with a as (select conv_id, turn, role, row_number() over (order by length(text) desc, conv_id, turn, role) - 1 as r from conversations order by r limit 200),
b as (select conv_id, turn, role, row_number() over (order by conv_id, turn, role) - 1 as r from conversations order by r limit 200),
u as (select *, 0 as l from a union all select *, 1 from b) select {key}, round(sum(1.0 / (60 + r)), 9) as _relevance_score from u group by {key}"""


def _collide(spark, sf_dir, strict: bool):
    c = table(spark, sf_dir, "conversations")
    keys = [F.col("conv_id"), F.col("turn"), F.col("role")]
    by_length, by_key = [F.desc(F.length("text")), *keys], keys
    lists = [fusion.ranked(c.orderBy(*o).limit(200), i, o) for i, o in enumerate((by_length, by_key))]
    names = ["conv_id", "turn", "role"] if strict else ["conv_id", "turn"]
    return fusion.rrf(lists, names).select(*names, "_relevance_score")


_query("fuse_rrf_collision", _collision(False))(lambda spark, sf_dir: _collide(spark, sf_dir, False))
_query("fuse_rrf_strict", _collision(True))(lambda spark, sf_dir: _collide(spark, sf_dir, True))


def _linear_sql(w: float) -> str:
    return f"with {_TEXT20}, {_VEC20} select doc_id, round({w} * coalesce(1 - d, 0.0) + (1 - {w}) * coalesce(s / (select max(s) from a), 0.0), 6) as _relevance_score from a full join b using (doc_id)"


def _linear(w: float):
    def run(spark, sf_dir):
        a, b = _branches(spark, sf_dir)
        return fusion.linear(a, b, ["doc_id"], w)

    return run


for _name, _w in (("fuse_linear_w0", 0.0), ("fuse_linear_w50", 0.5), ("fuse_linear_w100", 1.0)):
    _query(_name, _linear_sql(_w))(_linear(_w))


def _half(part: str, name: str) -> str:
    d = "round(1 - list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 5) + 0.0"
    return f"{name} as (select vec_id as doc_id, row_number() over (order by {d}, vec_id) - 1 as r from (select vec_id, embedding[{part}]::double[] as x, (select embedding[{part}]::double[] from embeddings where vec_id = 7) as y from embeddings) order by r limit 60)"


@_query(
    "fuse_all_three",
    f"with {_TEXT20}, {_half('1:32', 'b')}, {_half('33:64', 'c')}, u as (select doc_id, 0 as l, r from a union all select doc_id, 1, r from b union all select doc_id, 2, r from c), "
    "f as (select doc_id, round(sum(1.0 / (60 + r)), 9) as s, min(l * 1000 + r) as o from u group by doc_id) select doc_id, s as _relevance_score from f order by s desc, o, doc_id limit 20",
)
def fuse_all_three(spark, sf_dir):
    docs, e, q = documents(spark, sf_dir), table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)
    lists = [fusion.ranked(_rounded(fts.bm25(docs, TERMS), 60), 0, [F.desc("_score"), F.col("doc_id")])]
    for i, at in ((1, 1), (2, 33)):
        half = e.select(F.col("vec_id").alias("doc_id"), F.slice("embedding", at, 32).alias("embedding"))
        near = vector.knn(half, q[at - 1 : at + 31], 60, ["doc_id"]).select("doc_id", "_distance")
        lists.append(fusion.ranked(near, i, [F.col("_distance"), F.col("doc_id")]))
    return fusion.best(fusion.rrf(lists, ["doc_id"]), 20, ["doc_id"])


@_query(
    "rerank_topk",
    f"""with {_bm25(TERMS)}, b as (select doc_id from scored order by round(s, 6) desc, doc_id limit 100), x as (select doc_id, list_distinct(t) as t from tok where doc_id in (select doc_id from b))
select doc_id, round(len(list_intersect(t, ['the', 'thans', 'other'])) / len(list_distinct(list_concat(t, ['the', 'thans', 'other']))), 6) as _relevance_score from x""",
)
def rerank_topk(spark, sf_dir):
    found = fts.bm25(documents(spark, sf_dir), TERMS).withColumn("_score", F.round("_score", 6))
    return fusion.rerank(found, fusion.overlap_score(F.col("text"), TERMS), [F.desc("_score"), F.col("doc_id")]).select("doc_id", "_relevance_score")


@_query(
    "search_hybrid_engine",
    f"""with {_bm25(TERMS)}, {_QV}, a as (select doc_id, row_number() over (order by round(s, 9) desc, doc_id) - 1 as r from scored qualify r < 60),
v as (select vec_id as doc_id, {_DIST} as d from embeddings, q order by 2, 1 limit 60), b as (select doc_id, row_number() over (order by d, doc_id) - 1 as r from v where doc_id in (select doc_id from documents)),
u as (select doc_id, 0 as l, r from a union all select doc_id, 1, r from b union all select doc_id, 2, r from b),
f as (select doc_id, round(sum(1.0 / (60 + r)), 9) as s, min(l * 1000 + r) as o from u group by doc_id order by s desc, o, doc_id limit 20), x as (select doc_id, list_distinct(t) as t from tok where doc_id in (select doc_id from f))
select doc_id, round(len(list_intersect(t, ['the', 'thans', 'other'])) / len(list_distinct(list_concat(t, ['the', 'thans', 'other']))), 6) as _relevance_score from x""",
)
def search_hybrid_engine(spark, sf_dir):
    chunks = documents(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("language"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    engine = search.Engine(chunks, ["doc_id"], vectors, vectors)
    return engine.search(search.Spec(q="the thans other", n=20, mode="all", text_vector=_vector(spark, sf_dir), rerank=True)).select("doc_id", "_relevance_score")


@_query(
    "embed_texts",
    r"""with w as (select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as w from benchmark),
h as (select item_id, ('0x' || substr(md5(w), 1, 15))::bigint % 64 as dim, case when substr(md5(w), 16, 1) >= '8' then 1 else -1 end as s from w), v as (select item_id, dim, sum(s) as s from h group by all),
n as (select item_id, sqrt(sum(s * s)) as n from v group by item_id) select item_id, dim::int as dim, round(s / n, 5) as value from v join n using (item_id) where s <> 0""",
)
def embed_texts(spark, sf_dir):
    """The values of each text's vector that are not zero, by the client that needs no server."""
    e = embed.embed(table(spark, sf_dir, "benchmark"), ["item_id"], "text")
    values = e.select("item_id", F.posexplode("embedding").alias("dim", "value")).where("value <> 0")
    return values.select("item_id", "dim", F.round(F.col("value").cast("double"), 5).alias("value"))


# --- ingest


@_query(
    "ingest_flatten",
    """with s as (select conv_id, turn, unnest(string_split(text, '. ')) as text, generate_subscripts(string_split(text, '. '), 1) - 1 as chunk_id from conversations)
select substr(sha1('conv/' || conv_id || '.mp4'), 1, 16) as doc_id, turn::int as speech_id, chunk_id::int as chunk_id, text from s""",
)
def ingest_flatten(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    chunk = lambda t: F.struct(*(F.lit(None).cast(k).alias(n) for n, k in (("id", "string"), ("start", "double"), ("end", "double"))), t.alias("text"), F.lit("").alias("language"), *(F.lit(None).cast(k).alias(n) for n, k in (("duration", "double"), ("language_prob", "double"), ("audio_frames", "bigint"), ("num_logits", "bigint"))))
    speech = F.struct(F.col("turn").cast("string").alias("speech_id"), F.lit(None).cast("string").alias("metadata"), F.transform(F.split("text", r"\. ", -1), chunk).alias("chunks"), F.array().cast("array<struct<start:double,end:double>>").alias("alignments"))
    docs = c.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".mp4")).alias("audio_path"), F.lit(16000).alias("sample_rate"), F.lit(None).cast("double").alias("duration"), F.array(speech).alias("speeches"))
    return ingest.flatten(docs).select("doc_id", "speech_id", "chunk_id", "text")


@_query("ingest_metadata_join", "select d.doc_id, quality, toxic from documents d left join labels l using (doc_id)")
def ingest_metadata_join(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


@_query(
    "ingest_contain",
    """select c.event_id as chunk_event, a.event_id as inner_event from events c join events a on a.user_id = c.user_id and c.event_type = 'purchase' and a.event_type = 'click'
and a.ts >= c.ts and a.ts + interval 1 minute <= c.ts + interval 1 hour""",
)
def ingest_contain(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("chunk_event"), F.col("ts").alias("start"), F.expr("ts + interval 1 hour").alias("end"))
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("inner_event"), F.col("ts").alias("a_start"), F.expr("ts + interval 1 minute").alias("a_end"))
    return intervals.inside(a, c, ["user_id"], "a_start", "a_end", "start", "end", seconds=3600).select("chunk_event", "inner_event")


@_query(
    "doc_rows",
    r"""with p as (select page_id, regexp_extract(url, '([^/]*)$', 1) as name, url from pages) select page_id, substr(sha1(url), 1, 16) as doc_id, name,
case when length(name) > 1 then substr(name, 1, 1) || regexp_replace(substr(name, 2), '\.[^.]*$', '') else name end as stem,
case when lower(regexp_extract(substr(name, 2), '\.([^.]*)$', 1)) = 'html' then 'text/html' else 'application/octet-stream' end as mime, 'https://media.example/' || name as uri from p""",
)
def doc_rows(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", media.doc_id(url).alias("doc_id"), media.basename(url).alias("name"), media.stem(url).alias("stem"), media.mime(url).alias("mime"), media.media_uri(url, F.lit("https://media.example//"), F.lit(None).cast("string")).alias("uri"))


@_query("page_documents", "select doc_id, lang, (select greatest(1, ceil(count(*) / 24)) from documents)::bigint as n_pages from documents order by doc_id limit 24 offset 24")
def page_documents(spark, sf_dir):
    d = documents(spark, sf_dir)
    total = d.agg(maintain.pages(F.count("*")).cast("long").alias("n_pages"))
    return maintain.page(d.select("doc_id", "lang"), ["doc_id"], 2).join(F.broadcast(total))  # one row


@_query("key_lookup", "select conv_id, turn, role, text from conversations where conv_id = 3 and turn = 1")
def key_lookup(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("conv_id = 3 and turn = 1").select("conv_id", "turn", "role", "text")


@_query("free_predicate", "select doc_id, n_chars from documents where lang = 'de' and n_chars between 500 and 900")
def free_predicate(spark, sf_dir):
    return documents(spark, sf_dir).where(F.expr("lang = 'de' and n_chars between 500 and 900")).select("doc_id", "n_chars")


@_query("hit_columns", "select doc_id, coalesce(source, 'documents/' || doc_id) as title, 0.0::double as start, coalesce(n_chars, 0)::double as \"end\", '' as text from documents")
def hit_columns(spark, sf_dir):
    """Whole-document hits: a title, the whole span, no text."""
    title = F.coalesce("source", F.concat(F.lit("documents/"), F.col("doc_id").cast("string")))
    return documents(spark, sf_dir).select("doc_id", title.alias("title"), F.lit(0.0).alias("start"), F.coalesce("n_chars", F.lit(0)).cast("double").alias("end"), F.lit("").alias("text"))


# --- aggregates and maintenance


@_query("count_by_status", "select o_orderstatus as status, count(*)::bigint as n, min(o_orderkey)::bigint as first_key from orders group by 1")
def count_by_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status")
    return maintain.status_histogram(o, "status", "o_orderkey")


@_query("count_nulls", "select count(*)::bigint as n, count(*) filter (quality is null)::bigint as n_null from documents left join labels using (doc_id)")
def count_nulls(spark, sf_dir):
    return ingest_metadata_join(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("n_null"))


TABLES = ("conversations", "documents", "embeddings", "events", "labels", "orders", "pages")


@_query("health_counts", " union all ".join(f"select '{t}' as name, count(*)::bigint as n_rows from {t}" for t in TABLES))
def health_counts(spark, sf_dir):
    return maintain.health({t: table(spark, sf_dir, t) for t in TABLES})


@_query("resume_antijoin", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_antijoin(spark, sf_dir):
    return maintain.missing(documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@_query("resume_composite", "select l_orderkey, l_linenumber, l_partkey from lineitem l where not exists (select 1 from lineitem h where h.l_orderkey = l.l_orderkey and h.l_linenumber = l.l_linenumber and h.l_quantity < 25)")
def resume_composite(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return maintain.missing(lines.drop("l_quantity"), lines.where("l_quantity < 25"), ["l_orderkey", "l_linenumber"])


@_query("merge_backfill", "select d.doc_id, case when l.doc_id is not null then l.quality::bigint else d.n_chars end as n_chars from documents d left join labels l using (doc_id)")
def merge_backfill(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "n_chars")
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"))
    return maintain.merge(d, new, ["doc_id"], ["n_chars"])


@_query(
    "source_resolve_missing",
    """with d as (select doc_id, source, doc_id % 3 = 0 as absolute, '/media/in/' || source || '/' || doc_id || '.mp4' as there from documents), f as (select there from d where doc_id % 4 <> 1 and doc_id in (select doc_id from labels))
select count(f.there)::bigint as found, (count(*) - count(f.there))::bigint as missing from d left join f using (there)""",
)
def source_resolve_missing(spark, sf_dir):
    """Relative paths against a root and absolute ones; files of the same name in another folder are not found."""
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp4"))
    docs = documents(spark, sf_dir).select("doc_id", name.alias("name"))
    there = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    folder = F.when(F.col("doc_id") % 4 == 1, "/other/in/").otherwise("/media/in/")
    files = there.select(F.concat(F.lit("file://"), folder, "name").alias("path"))
    asked = docs.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/media/in/"), "name")).otherwise(F.concat(F.lit("./"), "name")).alias("audio_path"))
    return maintain.resolve(asked, files, "/media/in")[1]


@_query(
    "lang_vote",
    """with s as (select user_id, event_type, sum(value) as s, min(event_id) as seen from events group by all), r as (select *, row_number() over (partition by user_id order by s desc, seen) as n from s)
select user_id, event_type, round(s / 3, 6) as probability from r where n = 1""",
)
def lang_vote(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return maintain.vote(e, ["user_id"], "event_type", "value", "event_id").withColumn("probability", F.round("probability", 6))


@_query("distinct_docs_in_hits", f"with {_bm25(TERMS)} select count(distinct doc_id)::bigint as n_docs from scored")
def distinct_docs_in_hits(spark, sf_dir):
    return fts.bm25(documents(spark, sf_dir), TERMS).agg(F.countDistinct("doc_id").alias("n_docs"))


@_query("round_robin_shard", "select doc_id, ((row_number() over (order by source, doc_id) - 1) % 4)::int as shard from documents")
def round_robin_shard(spark, sf_dir):
    return maintain.shard(documents(spark, sf_dir).select("doc_id", "source"), [F.col("source"), F.col("doc_id")], 4).select("doc_id", "shard")


@_query("last_duplicate_wins", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def last_duplicate_wins(spark, sf_dir):
    from tidewater.sources import transcripts

    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return transcripts.last_wins(e, "user_id", "o").select("user_id", "event_id", "event_type")


@_query("language_counts", "select lang, count(*)::bigint as n from documents group by lang")
def language_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")


@_query("concat_chunks", "select conv_id, md5(string_agg(trim(text), ' ' order by turn, role, text)) as text_md5, max(turn)::bigint as last_turn from conversations group by conv_id")
def concat_chunks(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("r"))
    return out.select("conv_id", F.md5(F.array_join(F.transform("r", lambda x: F.trim(x.text)), " ")).alias("text_md5"), F.element_at("r", -1).turn.cast("long").alias("last_turn"))


@_query("compact_report", "select 1::bigint as files_before, count(*)::bigint as n_rows, ceil(count(*) / 1048576)::bigint as files_after from documents")
def compact_report(spark, sf_dir):
    files = documents(spark, sf_dir).select(F.input_file_name().alias("f"))
    return files.agg(F.countDistinct("f").alias("files_before"), F.count("*").alias("n_rows"), F.ceil(F.count("*") / (1 << 20)).alias("files_after"))


# --- scalar functions

_CLOCK = "case when {t} // 3600 > 0 then printf('%02d:%02d:%02d', {t} // 3600, ({t} // 60) % 60, {t} % 60) else printf('%02d:%02d', ({t} // 60) % 60, {t} % 60) end"


@_query("timecode", f"with e as (select event_id, round_even(value * 10, 0)::bigint as t from events) select event_id, {_CLOCK.format(t='t')} as code from e")
def timecode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.timecode(F.col("value") * 10).alias("code"))


@_query("timecode_ms", f"with e as (select event_id, trunc(value * 10)::bigint as t, round_even((value * 10 - trunc(value * 10)) * 1000, 0)::bigint as ms from events) select event_id, {_CLOCK.format(t='t')} || '.' || printf('%03d', ms) as code from e")
def timecode_ms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.timecode_ms(F.col("value") * 10).alias("code"))


@_query("srt_time", "with e as (select event_id, floor(value * 10 * 1000)::bigint as ms from events) select event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) as code from e")
def srt_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.srt_time(F.col("value") * 10).alias("code"))


@_query("fmt_time", "with e as (select doc_id, floor(n_chars / 3 + 0.5)::bigint as t from documents) select doc_id, case when t // 3600 > 0 then printf('%d:%02d:%02d', t // 3600, (t // 60) % 60, t % 60) else printf('%d:%02d', t // 60, t % 60) end as code from e")
def fmt_time(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.fmt_time(F.col("n_chars") / 3).alias("code"))


@_query("duration_fmt", f"with e as (select doc_id, floor(n_chars / 3 + 0.5)::bigint as t from documents) select doc_id, {_CLOCK.format(t='t')} as code from e")
def duration_fmt(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.duration(F.col("n_chars") / 3).alias("code"))


# whole numbers only: tenths of a unit, rounded half up
_TENTHS = "((n * 20 + {u}) // {u2} // 10)::bigint || '.' || ((n * 20 + {u}) // {u2} % 10)::bigint || ' {name}'"
_BYTES = "case when n < 1024 then n || ' B' " + " ".join(f"when n < {u * 1024} then {_TENTHS.format(u=u, u2=2 * u, name=name)}" for u, name in ((1024, "kB"), (1024**2, "MB"))) + f" else {_TENTHS.format(u=1024**3, u2=2 * 1024**3, name='GB')} end"


@_query("bytes_fmt", f"select doc_id, {_BYTES} as code from (select doc_id, n_chars::bigint as n from documents)")
def bytes_fmt(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.bytes_fmt(F.col("n_chars")).alias("code"))


@_query("bytes_scales", f"select doc_id, {_BYTES} as code from (select doc_id, n_chars::bigint * (case doc_id % 3 when 0 then 1 when 1 then 1024 else 1048576 end)::bigint as n from documents)")
def bytes_scales(spark, sf_dir):
    """Sizes of every scale: a third of the documents each counted in bytes, kB and MB."""
    scale = F.element_at(F.array(*(F.lit(1024**k).cast("long") for k in range(3))), (F.col("doc_id") % 3 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", T.bytes_fmt(F.col("n_chars") * scale).alias("code"))


@_query(
    "whisper_segments",
    """select conv_id, turn, role, (turn * 30)::double as start, (turn * 30 + 2.5)::double as "end", trim(regexp_extract(text, '^[^<]*')) as text from conversations where trim(regexp_extract(text, '^[^<]*')) <> ''""",
)
def whisper_segments(spark, sf_dir):
    """Thirty-second windows of tokens, each shifted by its window's start."""
    raw = F.concat(F.lit("<|0.00|>"), F.regexp_extract("text", "^[^<]*", 0), F.lit("<|2.50|>"))
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(T.whisper_segments(raw)).alias("s"))
    shift = F.col("turn") * 30
    return s.select("conv_id", "turn", "role", (F.col("s.start") + shift).alias("start"), (F.col("s.end") + shift).alias("end"), "s.text")


@_query(
    "srt_export",
    """with c as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) as i, turn, role, text from conversations) select conv_id, md5(string_agg(i || chr(10) ||
printf('%02d:%02d:%02d,000', (turn * 30) // 3600, ((turn * 30) // 60) % 60, (turn * 30) % 60) || ' --> ' || printf('%02d:%02d:%02d,500', (turn * 30 + 2) // 3600, ((turn * 30 + 2) // 60) % 60, (turn * 30 + 2) % 60)
|| chr(10) || text || chr(10), chr(10) order by i)) as srt_md5 from c group by conv_id""",
)
def srt_export(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("r"))
    segments = F.transform("r", lambda x: F.struct((x.turn * 30).cast("double").alias("start"), (x.turn * 30 + 2.5).cast("double").alias("end"), x.text.alias("text")))
    return c.select("conv_id", F.md5(T.to_srt(segments, F.lit(""), F.lit(0))).alias("srt_md5"))


HEADERS = ("bytes=0-", "bytes=-5", "bytes=-0", "bytes=5-3", "bytes=10-99999", "bytes=-", "items=0-1", "bytes=0-0", " bytes=2-7 ")


@_query(
    "range_parse",
    rf"""with h(h) as (values {', '.join(f"('{h}')" for h in HEADERS)}), p as (select doc_id, n_chars as n, h, nullif(regexp_extract(h, '^\s*bytes=(\d*)-(\d*)\s*$', 1), '') as a, nullif(regexp_extract(h, '^\s*bytes=(\d*)-(\d*)\s*$', 2), '') as b from documents, h),
r as (select *, case when a is null then greatest(0, n - b::bigint) else a::bigint end as s, case when a is null then n - 1 else coalesce(b::bigint, n - 1) end as e from p where a is not null or b is not null)
select doc_id, h as header, s::bigint as range_start, least(e, n - 1)::bigint as range_end from r where s <= e and s < n""",
)
def range_parse(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "n_chars", F.explode(F.array(*(F.lit(h) for h in HEADERS))).alias("header"))
    d = d.withColumn("r", media.range_parse(F.col("header"), F.col("n_chars"))).where("r is not null")
    return d.select("doc_id", "header", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


@_query("range_read", "select page_id, case when strlen(html) > 10 then md5(unhex(substr(hex(encode(html)), 21, 180))) end as piece_md5, strlen(html)::bigint as size from pages")
def range_read(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("data", F.encode("html", "UTF-8"))
    r = media.range_parse(F.lit("bytes=10-99"), F.octet_length("data"))
    return p.select("page_id", F.md5(media.range_bytes(F.col("data"), r)).alias("piece_md5"), F.octet_length("data").cast("long").alias("size"))


@_query("json_roundtrip", "select event_id, (props->>'$.k')::bigint as k, '{\"k\":' || (props->>'$.k') || '}' as props from events")
def json_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", "p.k", F.to_json("p").alias("props"))


@_query("media_bytes", "select doc_id, (44 + 6 * (n_chars % 7 + 1))::int as size, '52494646' as magic from documents")
def media_bytes(spark, sf_dir):
    from tidewater.session import ready

    @F.pandas_udf("binary")
    def wav(n):
        return n.map(lambda k: media.wav_bytes([[0.0, 0.5, -1.0] * (int(k) % 7 + 1)], 16_000))

    d = ready(documents(spark, sf_dir)).select("doc_id", wav("n_chars").alias("wav"))
    return d.select("doc_id", F.octet_length("wav").alias("size"), F.hex(F.substring("wav", 1, 4)).alias("magic"))


@_query("jpeg_dims", "select page_id, length(url)::int as width, (length(html) % 4096)::int as height from pages")
def jpeg_dims(spark, sf_dir):
    head = "FFD8FFE000044A46FFC0000B08"
    p = table(spark, sf_dir, "pages").select("page_id", F.unhex(F.concat(F.lit(head), F.lpad(F.hex(F.length("html") % 4096), 4, "0"), F.lpad(F.hex(F.length("url")), 4, "0"), F.lit("010111"))).alias("jpeg"))
    return media.jpeg_sizes(p, "page_id", "jpeg").withColumnRenamed("id", "page_id")


@_query(
    "language_codes",
    """select doc_id, case lang when 'en' then 'eng' when 'fr' then 'fra' when 'de' then 'ger' else lang end as code, lang as language, case lang when 'en' then 'facebook/wav2vec2-base-960h' end as model from documents""",
)
def language_codes(spark, sf_dir):
    code = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fra").when(F.col("lang") == "de", "ger").otherwise(F.col("lang"))
    return documents(spark, sf_dir).select("doc_id", code.alias("code"), lookup.language(code).alias("language"), lookup.default_model(lookup.language(code)).alias("model"))


@_query(
    "event_labels",
    """select event_id, 'transcript-' || strftime(ts, '%Y%m%d-%H%M%S') || '-' || event_type as name, regexp_full_match(event_type, '[a-z_]{2,10}') as valid,
case event_type when 'click' then 100.0 when 'error' then 0.0 else least(100.0, (event_id % 5 + 1) / 4 * 100) end::double as progress,
case when event_id % 2 + event_id % 3 % 2 = 2 then 'green' when event_id % 2 + event_id % 3 % 2 = 1 then 'amber' else 'red' end as tone, greatest(5.0, least(20.0, value))::double as clamped from events""",
)
def event_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "error", "error").otherwise("transcribing")
    return e.select(
        "event_id", T.export_name(F.col("ts"), F.col("event_type")).alias("name"), T.valid_label(F.col("event_type")).alias("valid"), T.progress(status, F.col("event_id") % 5, F.lit(4)).alias("progress"),
        T.tone(F.col("event_id") % 2 == 1, F.col("event_id") % 3 == 1).alias("tone"), T.clamp(F.col("value"), 5.0, 20.0).alias("clamped"),
    )


@_query("media_classes", r"""select page_id, case when page_id % 3 = 0 then 'video' when page_id % 3 = 1 then 'audio' else 'other' end as class, case when page_id % 3 = 0 then 'video/mp4' when page_id % 3 = 1 then 'audio/ogg' else 'application/octet-stream' end as mime,
case when page_id % 3 = 0 then 'mp4' when page_id % 3 = 1 then 'ogg' else 'audio' end as ext from pages""")
def media_classes(spark, sf_dir):
    name = F.concat(F.lit("in/x."), F.element_at(F.array(F.lit("MP4"), F.lit("ogg"), F.lit("bin")), (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", media.media_class(name).alias("class"), media.mime(name).alias("mime"), media.audio_extension(media.mime(name)).alias("ext"))


# --- hits, stores and jobs


def _chunks(spark, sf_dir):
    """Chunks of the documents' lines in the shape of hits, with alignments of their words (0.4 s each)."""
    d = documents(spark, sf_dir).select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("chunk_id", "text"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp4"))
    return d.select(media.doc_id(path).alias("doc_id"), path.alias("audio_path"), F.lit(0).alias("speech_id"), "chunk_id", (F.col("chunk_id") * 30.0).alias("start"), (F.col("chunk_id") * 30.0 + 30).alias("end"), F.lit(30.0).alias("duration"), "text", F.col("lang").alias("language"))


_CHUNKS = """ch as (select substr(sha1(source || '/' || doc_id || '.mp4'), 1, 16) as doc_id, source || '/' || doc_id || '.mp4' as audio_path, 0 as speech_id, (i - 1)::int as chunk_id, (i - 1) * 30.0::double as start,
  (i - 1) * 30.0::double + 30 as "end", 30.0::double as duration, l as text, lang as language from (select doc_id, source, lang, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"""


@_query("hit_brief", f'with {_CHUNKS} select doc_id, audio_path, speech_id, chunk_id, start, "end", duration, md5(text) as text, language from ch')
def hit_brief(spark, sf_dir):
    return hits.brief(_chunks(spark, sf_dir)).withColumn("text", F.md5("text"))


@_query("hit_full", "select conv_id::varchar as doc_id, turn::int as chunk_id, text, 1::int as n_alignments, (turn * 0.5)::double as first_start, text as first_text from conversations")
def hit_full(spark, sf_dir):
    """The answer of a service, its alignments stored as JSON and parsed again."""
    c = table(spark, sf_dir, "conversations")
    align = F.to_json(F.array(F.struct((F.col("turn") * 0.5).alias("start"), (F.col("turn") * 0.5 + 1).alias("end"), "text")))
    none = {k: F.lit(None).cast("string") for k in ("namn", "referenskod", "bildid", "extraid", "audio_path", "language")}
    rows = c.select(F.lit(1.0).alias("_score"), F.col("conv_id").cast("string").alias("doc_id"), F.lit(0).alias("speech_id"), F.col("turn").cast("int").alias("chunk_id"), *(F.lit(x).alias(k) for k, x in (("start", 0.0), ("end", 1.0), ("duration", 1.0))), "text", align.alias("alignments_json"))
    got = hits.full(rows.withColumns(none))
    return got.select("doc_id", "chunk_id", "text", F.size("alignments").alias("n_alignments"), F.col("alignments")[0].start.alias("first_start"), F.col("alignments")[0].text.alias("first_text"))


@_query(
    "hit_listing",
    f"""with {_CHUNKS}, r as (select row_number() over (order by length(text) desc, audio_path, chunk_id) as rank, * from ch order by 1 limit 20)
select rank::int as rank, lpad(rank::varchar, 2, ' ') || '. [' || {_CLOCK.format(t='start::bigint')} || '→' || {_CLOCK.format(t='"end"::bigint')} || '] ' || regexp_extract(audio_path, '([^/]*)$', 1) || chr(10) || '     ' || text as line from r""",
)
def hit_listing(spark, sf_dir):
    order = [F.desc(F.length("text")), F.col("audio_path"), F.col("chunk_id")]
    best = _chunks(spark, sf_dir).orderBy(*order).limit(20)
    return hits.listing(best, [-F.length("text"), F.col("audio_path"), F.col("chunk_id")])


@_query("hit_lookup", "select event_id, e.user_id, c_name as name, case when n_name is not null then n_name end as nation from events e left join customer on c_custkey = e.user_id left join nation on n_nationkey = e.event_id where e.event_type = 'click'")
def hit_lookup(spark, sf_dir):
    """Each hit with the rows that belong to it in two other tables."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id", F.col("user_id").alias("doc_id"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    frames = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("event_id"), "n_name")
    out = hits.lookup(e, docs, frames, ("event_id",))
    return out.select("event_id", "user_id", F.col("document.c_name").alias("name"), F.col("frame.n_name").alias("nation"))


@_query("hit_more", f"with {_bm25(TERMS)} select doc_id, round(s, 6) as _score from scored order by 2 desc, 1 limit 50")
def hit_more(spark, sf_dir):
    """Twenty hits, then thirty more by the same search with a larger limit."""
    engine = search.Engine(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    found, _ = hits.more(engine.search, search.Spec(q=" ".join(TERMS), n=20), 20)
    return found.select("doc_id", F.round("_score", 6).alias("_score"))


@_query("resume_first", "select doc_id from documents where doc_id not in (select doc_id from labels) order by doc_id limit 10")
def resume_first(spark, sf_dir):
    return hits.first(documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], 10)


@_query("answers_in_order", "select event_id as index, round(value, 6) as score from events")
def answers_in_order(spark, sf_dir):
    """Scores that came back in any order, each with its question's number."""
    answers = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), F.round("value", 6).alias("score"))
    return hits.in_order(answers.repartition(F.xxhash64("index")))


@_query("ascii_edge_words", r"""select doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: lower(regexp_replace(w, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g')) in ('the', 'thans', 'other', 't')), '|') as words from documents""")
def ascii_edge_words(spark, sf_dir):
    terms = F.array(*(F.lit(t) for t in [*TERMS, "t"]))
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.ascii_word_match(F.split("text", " "), terms), "|").alias("words"))


@_query("job_outcome", "with s as (select event_id, case event_type when 'error' then 'failed' when 'click' then 'ok' else 'missing' end as status from events) select status, count(*)::bigint as n, case when status = 'failed' then (select string_agg(event_id::varchar, ',' order by event_id::varchar) from (select event_id from s where status = 'failed' order by event_id limit 5)) end as first_failures from s group by status")
def job_outcome(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "ok").otherwise("missing")
    e = table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.lit("gone").alias("error"))
    return maintain.outcome(e, "status", "event_id", "error").select("status", "n", F.array_join(F.transform("failures", lambda f: f.key), ",").alias("first_failures"))


@_query("queue_counts", "select count(*) filter (s = 'queued')::bigint as queued, count(*) filter (s = 'done')::bigint as done, count(*) filter (s = 'error')::bigint as error, count(*) filter (s in ('done', 'error'))::bigint as processed from (select case event_type when 'click' then 'done' when 'error' then 'error' when 'view' then 'queued' else 'running' end as s from events)")
def queue_counts(spark, sf_dir):
    s = F.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "queued").otherwise("running")
    return maintain.queue(table(spark, sf_dir, "events").select(s.alias("status")))


@_query("end_ms", "select conv_id, floor((max(turn) * 30 + 2.5004) * 1000 + 0.5)::bigint as duration_ms from conversations group by conv_id")
def end_ms(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", (F.col("turn") * 30 + 2.5004).cast("double").alias("end"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("r")).select("conv_id", T.end_ms(F.col("r")).alias("duration_ms"))


@_query("file_uris", "select page_id, 'file://' || replace(replace(replace(replace(url_encode('/in put/ö+*~' || url), '%2F', '/'), '+', '%20'), '*', '%2A'), '%7E', '~') as uri, coalesce(nullif(case when page_id % 3 = 0 then 'image/png' when page_id % 3 = 1 then '' end, ''), 'image/jpeg') as mime from pages")
def file_uris(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    path, stored = F.concat(F.lit("/in put/ö+*~"), F.col("url")), F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "")
    return p.select("page_id", media.media_uri(path, F.lit(None).cast("string"), path).alias("uri"), media.mime_or(stored, "image/jpeg").alias("mime"))


@_query("compact_swap", "select count(*)::bigint as n_rows, count(distinct doc_id)::bigint as n_docs, sum(n_chars)::bigint as chars, 1 as files from documents")
def compact_swap(spark, sf_dir):
    """A table of many small files, compacted in place."""
    path = maintain.work_folder(spark, "store") + "/documents"
    documents(spark, sf_dir).select("doc_id", "n_chars").repartition(7).write.parquet(path)
    counts = store.compact(spark, path, 1 << 20)
    return tables.read(spark, path).agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_docs"), F.sum("n_chars").alias("chars")).withColumn("files", F.lit(counts["files_after"]))


def _index(spark, sf_dir):
    return fts.Index(maintain.work_folder(spark, "index")).build(documents(spark, sf_dir), fuzzy=False)


@_query("fts_index_match", f"with {_bm25(TERMS)} select doc_id, round(s, 6) as _score from scored order by 2 desc, 1 limit 20")
def fts_index_match(spark, sf_dir):
    """From stored postings: only those of the query's terms are read."""
    found = _index(spark, sf_dir).match(spark, list(TERMS)).select(F.col("key").alias("doc_id"), F.round("_score", 6).alias("_score"))
    return fts.top(found, 20, "doc_id")


@_query(
    "fts_index_phrase",
    f"""with {_TOK}, corpus as (select count(*) as n, avg(len(t)) as avgdl from tok),
tf as (select doc_id, len(t) as dl, {_phrase_tf('tf', ['of', 'the'])}, list_contains(t, 'from') as x from tok), df as (select count(*) as df from tf where tf > 0)
select doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as _score from tf, df, corpus where tf > 0 and not x""",
)
def fts_index_phrase(spark, sf_dir):
    """A phrase without a word, by stored positions."""
    return _index(spark, sf_dir).match(spark, fts.parse('+"of the" -from')).select(F.col("key").alias("doc_id"), F.round("_score", 6).alias("_score"))


# --- time windows


@_query("tumbling_30s", "select time_bucket(interval 30 seconds, ts) as start, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1")
def tumbling_30s(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"))


@_query("sliding_30s", "select time_bucket(interval 10 seconds, ts) - (k * interval 10 seconds) as start, count(*)::bigint as n from events, range(3) r(k) group by 1")
def sliding_30s(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"), "30 seconds", "10 seconds")


@_query(
    "sessions",
    """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, max(ts) as last, count(*)::bigint as n from s group by user_id, s""",
)
def sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "user_id", "6 hours")


@_query("stream_append_dedup", "select event_type, count(distinct event_id)::bigint as n from events group by 1")
def stream_append_dedup(spark, sf_dir):
    """Events through a stream into a keyed table, twice; the second pass adds nothing."""
    from tidewater.sources import sinks

    root = maintain.work_folder(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    for turn in range(2):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        stream = stream.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
        sinks.append_stream(stream, f"{root}/table", f"{root}/checkpoint-{turn}", ["event_id"]).awaitTermination()
    return tables.read(spark, f"{root}/table").groupBy("event_type").agg(F.count("*").alias("n"))


@_query(
    "point_in_interval",
    """with s as (select user_id, event_id, ts as start, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events), p as (select doc_id, doc_id % 150 as user_id, timestamp '2024-01-01' + to_minutes(doc_id * 7) as t from documents)
select doc_id, max(event_id)::bigint as event_id from p join s on p.user_id = s.user_id and t >= start and t < coalesce(least(nxt, start + interval 10 minute), start + interval 10 minute) group by doc_id""",
)
def point_in_interval(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("start"), F.lead("ts").over(w).alias("nxt"))
    s = s.withColumn("end", F.coalesce(F.least("nxt", F.expr("start + interval 10 minutes")), F.expr("start + interval 10 minutes")))
    p = documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 150).alias("user_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(doc_id * 7 as int))").alias("t"))
    return intervals.points(p, s, ["user_id"], "t", "start", "end", seconds=600).groupBy("doc_id").agg(F.max("event_id").alias("event_id"))


from tidewater.plans import upkeep  # noqa: E402, F401  its queries are registered here


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
