"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, flatids, licenses, minhash, pii, quality, resample, secrets, tokens, trie, urls, warc
from tidewater.llm.common import work_dir

#: Where vocabulary files of public tokenizers are.
TOKENIZERS = os.environ.get("TIDEWATER_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"{TOKENIZERS}/{name}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("coverage", F.round("coverage", 6))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return tokens.encode(docs, vocabulary("piece_bpe_32k.model"), 0.1, seed=7, keep=("n_tokens", "ids_crc32", "lossless"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("lang", "source", "n_lines").withColumn("distance", F.round("distance", 6))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-ids")
    flatids.write(_table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return flatids.read(spark, folder)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, least=20, seed=42)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"), share=5, most=9)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, work_dir(spark, "secrets"))
    ledger.scan(docs)
    return secrets.digest(docs, ledger)


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_decontamination": op2_decontamination,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_quality_rules": op4_quality_rules,
        "op5_pii": op5_pii,
        "op6_minhash": op6_minhash,
        "op7_url_filter": op7_url_filter,
        "op8_token_counts": op8_token_counts,
        "op9_token_files": op9_token_files,
        "op10_license_scan": op10_license_scan,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_secret_scan": op13_secret_scan,
    }


_OP1 = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as h, max(page_id) over (partition by html) as canon from p),
b as (select *, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i::int + 1, 5))::int) as parts from d)
select page_id, payload_bytes,
  array_to_string(list_transform(parts, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') as payload_digest,
  case when page_id = canon then 'response' else 'revisit' end as record_type,
  case when page_id = canon then null else canon end as refers_to
from b
"""

_OP6 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [md5(array_to_string(ws, ' '))]
    else list_transform(range(len(ws) - 4), lambda i: md5(array_to_string(ws[i + 1 : i + 5], ' '))) end) as sh from w),
x as (select doc_id, unnest(sh) as k from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as n from x a join x b on a.k = b.k and a.doc_id < b.doc_id group by all),
l as (select c.a, c.b from c join s sa on sa.doc_id = c.a join s sb on sb.doc_id = c.b where 100 * c.n >= 85 * (len(sa.sh) + len(sb.sh) - c.n)),
e as (select a, b from l union all select b, a from l),
r(id, root) as (select doc_id, doc_id from s union select e.b, r.root from r join e on e.a = r.id),
m as (select id, min(root) as component_id from r group by id)
select s.doc_id, len(s.sh)::bigint as n_shingles, m.component_id, s.doc_id = m.component_id as kept from s join m on m.id = s.doc_id
"""


def _op10(percent: int = 80) -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
    # short notices: all words, in order
    order = lambda t: "'(^| )" + " (.* )?".join(t.split()) + "( |$)'" if len(t.split()) < licenses.SHORT else "null::varchar"
    templates = ", ".join(f"('{t}', '{label}', {licenses.size_of(len(t.split()))}, {order(t)})" for label, t in licenses.defaults())
    return rf"""
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws, t from d),
ph(phrase, label) as (values {phrases}),
hit as (
  select doc_id, label, unnest(list_filter(range(len(ws)), lambda i: array_to_string(ws[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase)) as place
  from w join ph on contains(replace(array_to_string(ws, ' '), '  ', ' '), phrase)),
base as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as ls from hit group by doc_id),
tp(words, label, size, pattern) as (select list_distinct(string_split(t, ' ')), label, size, pattern from (values {templates}) v(t, label, size, pattern)),
ln as (select doc_id, regexp_extract_all(unnest(list_concat([t], string_split(t, chr(10)))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from d),
bl as (select doc_id, size, ws[s + 1 : s + 2 * size] as ws from (select doc_id, ws, size, unnest(range(0, len(ws), size)) as s from ln, (select distinct size from tp))),
mt as (select doc_id, label, pattern, ws, len(list_intersect(list_distinct(ws), words)) as n, len(words) as m from bl join tp using (size)),
sim as (select doc_id, list(distinct label) as ls, max(n / m) as score from mt
  where case when pattern is null then 100 * n >= {percent} * m else n = m and regexp_matches(array_to_string(ws, ' '), pattern) end group by doc_id)
select w.doc_id, len(w.ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  array_to_string(list_sort(coalesce(base.ls, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(sim.ls, [])))), ',') as labels,
  (case when n_base > 0 then 1.0 else coalesce(sim.score, 0.0) end)::double as score
from w left join base using (doc_id) left join sim using (doc_id)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: One row: the 256 remainders of CRC-32; and the checksum of a list of bytes.
_CRC_TABLE = "crc_table as (select list(list_reduce(list_concat([i], range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab from range(256) r(i))"
_CRC = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::int])), 4294967295)"

_OP11 = rf"""
with {_CRC_TABLE},
w as (select 0 as side, doc_id as id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all select 1, null, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
f as (select side, id, unnest(list_concat(ws, list_transform(range(len(ws) - 1), lambda i: ws[i + 1] || ' ' || ws[i + 2]),
  list_transform(range(len(ws) - 2), lambda i: ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]))) as f from w),
n as (select side, id, f, count(*) as n from f group by all),
h as (select f, hex(encode(f)) as x from (select distinct f from n)),
v as (select f, {_CRC.format(bytes="list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint)")} % 10000 as bucket from h, crc_table),
b as (select bucket, sum(n) filter (side = 0) as s, sum(n) filter (side = 1) as t from n join v using (f) group by bucket),
totals as (select coalesce(sum(s), 0)::double as big_s, coalesce(sum(t), 0)::double as big_t from b),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (big_s + 10000) / ((coalesce(s, 0) + 1)::double * (big_t + 10000))))::bigint as gain from b, totals),
d as (select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from n join v using (f) join g using (bucket) where side = 0 group by id),
e as (select w.id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from w left join d on d.id = w.id where side = 0),
r as (select *, row_number() over (partition by n_words >= 20 order by score desc, id) as r, count(*) filter (n_words >= 20) over () as n from e)
select id as doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, (case when n_words >= 20 and r <= 5 * n // 100 then r end)::bigint as rank from r
"""

_OP12 = f"""
with {_CRC_TABLE},
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, k) as p, k, b from (select conv_id, turn, strlen(coalesce(text, '')) as b,
  substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) as k from conversations where conv_id is not null)),
own as (select conv_id, list(k order by p) as ks, list(b order by p) as bs from t group by conv_id),
h as (select *, (({_CRC.format(bytes="list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)")}) % 9)::int as h from own, crc_table),
re as (select a.conv_id, list_concat(coalesce(d.ks, [])[1 : a.h], a.ks[a.h + 1 :]) as ks, list_concat(coalesce(d.bs, [])[1 : a.h], a.bs[a.h + 1 :]) as bs
  from h a left join own d on d.conv_id = a.conv_id - a.conv_id % 5),
pre as (select conv_id, len(ks) as l, d, md5(array_to_string(ks[1 : d], ',')) as id, case when d > 0 then md5(array_to_string(ks[1 : d - 1], ',')) end as up, case when d > 0 then bs[d] else 0 end as b
  from (select *, unnest(range(len(ks) + 1)) as d from re)),
node as (select id, d, any_value(up) as up, any_value(b) as b, min(conv_id) as conv_id, count(*) as n,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (l = d), '')) as ends from pre group by id, d),
kids as (select up as id, count(*) as c from node where up is not null group by up),
sub as (select p.id, sum((n.n - 1) * n.b) as saved, count(*) filter (k.c is null) as leaves
  from node n left join kids k on k.id = n.id join pre p on p.conv_id = n.conv_id and p.d <= n.d group by p.id)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n::bigint as n_convs, coalesce(k.c, 0)::bigint as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, n.ends as ends_sha256
from node n left join node u on u.id = n.up left join kids k on k.id = n.id join sub s on s.id = n.id
"""

#: The base rules in the dialect of DuckDB: kind, all matches, group whose characters count, and how many there must be.
_SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA([A-Z0-9]+)", 1, 12),
    ("hex", r"[0-9a-f]+", 0, 32),
)


def _op13() -> str:
    q = lambda s: s.replace("'", "''")
    every = [*_SECRETS, *((r.kind, r.matches, r.group, r.least) for r in secrets.EXTRA)]
    rules = ", ".join(f"({i}, '{k}', {least})" for i, (k, _, _, least) in enumerate(every))
    each = " union all ".join(
        f"select blob, {i} as rule, string_split_regex(text, '{q(p)}') as gaps, regexp_extract_all(text, '{q(p)}') as got, regexp_extract_all(text, '{q(p)}', {g}) as part from b" for i, (_, p, g, _) in enumerate(every)
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as text, sha256(coalesce(text, '')) as blob from documents),
b as (select distinct blob, text from d), m as ({each}),
x as (select blob, rule, unnest(gaps[1 : len(got)]) as gap, unnest(got) as got, unnest(part) as part, unnest(range(len(got))) as i from m),
y as (select *, sum(length(gap) + length(got)) over (partition by blob, rule order by i)::bigint as stop from x),
s as (select blob, kind, rule, (stop - length(got))::bigint as start, stop from y join (values {rules}) r(rule, kind, least) using (rule) where length(part) >= least),
z as (select blob, rule, kind || ':' || start || ':' || stop as span, start from s),
g as (select blob, string_agg(span, ',' order by start, rule) as spans, string_agg(span, ',' order by start, rule) filter (rule < 3) as base,
  count(*) filter (rule = 0) as n0, count(*) filter (rule = 1) as n1, count(*) filter (rule = 2) as n2, count(*) filter (rule > 2) as n3 from z group by blob)
select doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n3, 0)::bigint as n_more, blob
from d left join g using (blob)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _OP1, "op6_minhash": _OP6, "op10_license_scan": _op10(), "op11_importance_resampling": _OP11, "op12_prefix_trie": _OP12, "op13_secret_scan": _op13()}
