"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) come from patterns with checks and always stay. Candidates of further kinds (secret,
ssn, iban) come from broad patterns. Three labelers vote on each candidate with 1, 0 or -1: a regex labeler on its strict
shape, a gazetteer labeler on known words shortly before it, a context labeler on the characters around it. Candidates are
counted by kind, votes and shape (a bounded number of cells); from the counts of the whole table, expectation-maximisation
estimates the labelers' reliabilities and each cell's probability, and a logistic span classifier is trained on those. The
classifier, as a SQL expression, decides on every candidate.

Patterns are written so that Java's matcher needs neither recursion nor repeated scans of long runs: possessive repeats, and
a match may begin at a run's start or where the last match ended.

Defined results: null texts are empty (no spans; they stay null when redacted); places count code points; repeated rows are
judged each; without candidates the classifier accepts none. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialise, packed

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "ssn", "iban")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
#: What a text must hold for a pattern to be tried at all; cheap to find.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
STRICT = {"secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:sk|ghp|AKIA)[A-Za-z0-9]{16,})$", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", "iban": r"^[A-Z]{2}[0-9]{13,32}$|^[A-Z]{2}[0-9]{2}[A-Z]{4}[0-9]{6,24}$"}
LOOSE = {"secret": r"^[A-Za-z]{18,}[0-9]{1,2}$|^[0-9]+[A-Za-z]{1,2}$", "ssn": r"^(?:000|666|9)", "iban": r"^[A-Z0-9]*[A-Z]{12,}"}
#: Words shortly before a candidate that speak for or against it.
FOR = {"secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential)", "ssn": r"(?i)(?:ssn|social security|taxpayer)", "iban": r"(?i)(?:iban|account|bank|konto|compte|cuenta)"}
AGAINST = {"secret": r"(?i)(?:commit|sha-?1|sha-?256|md5|checksum|digest|etag|uuid|isbn)", "ssn": r"(?i)(?:order|invoice|part|item|isbn|tel|fax)", "iban": r"(?i)(?:serial|model|part|sku)"}
BEFORE = 32


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of 10."""
    rev = F.split(F.reverse(_digits(x)), "")
    worth = F.transform(rev, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        small = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return x.rlike(rf"^{small}\.{small}\.{small}\.{small}$")
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,text:string,before:string,after:string>>"


def _found(kind: str, text: Column) -> Column:
    """All matches of a kind, with places and surroundings. Between matches lie the parts that split gives."""
    got = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    if kind in NEEDS:
        got = F.when(F.contains(text, F.lit(NEEDS[kind])), got).otherwise(F.array().cast("array<string>"))
    return got


def _placed(kind: str, text: Column, got: Column) -> Column:
    parts = F.split(text, PATTERNS[kind], -1)
    rows = F.transform(got, lambda m, i: F.struct(m.alias("text"), F.element_at(parts, i + 1).alias("gap"), F.coalesce(F.try_element_at(parts, i + 2), F.lit("")).alias("next")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        begin = acc.at + F.length(r.gap)
        end = begin + F.length(r.text)
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), r.text.alias("text"), F.right(r.gap, F.lit(BEFORE)).alias("before"), F.left(r.next, F.lit(4)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(span)).alias("out"))

    placed = F.aggregate(rows, start, step, lambda a: a.out)
    if kind in BASE:
        placed = F.filter(placed, lambda s: _valid(kind, s.text))
    return F.when(F.size(got) > 0, placed).otherwise(F.array().cast(_SPAN))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes & ~no, 1).when(no & ~yes, -1).otherwise(0)


def _by_kind(kind: Column, make) -> Column:
    out = F.lit(False)
    for k in EXTRA:
        out = F.when(kind == k, make(k)).otherwise(out)
    return out


def _voted(s: Column) -> Column:
    n = F.length(s.text)
    share = F.floor(4 * F.length(_digits(s.text)) / n).cast("int")
    return F.struct(
        s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"),
        _vote(_by_kind(s.kind, lambda k: s.text.rlike(STRICT[k])), _by_kind(s.kind, lambda k: s.text.rlike(LOOSE[k]))).alias("v_regex"),
        _vote(_by_kind(s.kind, lambda k: s.before.rlike(FOR[k])), _by_kind(s.kind, lambda k: s.before.rlike(AGAINST[k]))).alias("v_gazetteer"),
        _vote(s.before.rlike(r"[=:][ ]?[\"']?$|[\"']$") | s.after.rlike(r"^[\"']"), s.before.rlike(r"[/#&?._-]$") | s.after.rlike(r"^[/_.-][A-Za-z0-9]")).alias("v_context"),
        F.least(F.floor(n / 10), F.lit(7)).cast("int").alias("size"), F.least(share, F.lit(3)).alias("digits"),
    )


def spans(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and __base (checked base spans by kind and place) and __more (candidates with votes)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = (*BASE, *EXTRA)
    out = docs.select(*keep, whole.alias("__whole"))
    out = out.select(*keep, "__whole", *(_found(k, F.col("__whole")).alias(f"__m_{k}") for k in kinds))
    out = out.select(*keep, *(_placed(k, F.col("__whole"), F.col(f"__m_{k}")).alias(f"__s_{k}") for k in kinds))
    thin = lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))
    return out.select(
        *keep, F.concat(*(F.transform(f"__s_{k}", thin) for k in BASE)).alias("__base"), F.concat(*(F.transform(f"__s_{k}", _voted) for k in EXTRA)).alias("__more")
    )


VOTES = ("v_regex", "v_gazetteer", "v_context")
CELL = ("kind", *VOTES, "size", "digits")


def cells(found: DataFrame) -> list[tuple]:
    """(kind, votes, size, digits, count): at most 3 kinds x 27 votes x 8 sizes x 4 shares, whatever the table's size."""
    got = found.select(F.explode("__more").alias("c")).groupBy(*(F.col(f"c.{x}").alias(x) for x in CELL)).count()
    return sorted((*(r[x] for x in CELL), r["count"]) for r in got.collect())


def aggregate_votes(rows: list[tuple], rounds: int = 60) -> tuple[dict, dict]:
    """EM for labelers that are independent given the truth: (probability of each (kind, votes), reliabilities[labeler][truth][vote])."""
    counts: dict[tuple, int] = defaultdict(int)
    for kind, a, b, c, _, _, n in rows:
        counts[kind, (a, b, c)] += n
    start = lambda: [{1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.1, 0: 0.6, -1: 0.3}} for _ in VOTES]
    rel, prior, post = start(), {k: 0.5 for k, _ in counts}, {}
    for _ in range(rounds):
        for k, v in counts:
            like = [math.log(prior[k]) + sum(math.log(rel[j][1][x]) for j, x in enumerate(v)), math.log(1 - prior[k]) + sum(math.log(rel[j][0][x]) for j, x in enumerate(v))]
            post[k, v] = 1 / (1 + math.exp(min(700, like[1] - like[0])))
        base = start()  # the start, worth 10 votes each, keeps the two truths from changing places and from certainty
        for j in range(len(VOTES)):
            for truth in (1, 0):
                sums = {x: 10 * base[j][truth][x] for x in (1, 0, -1)}
                for (k, v), n in counts.items():
                    sums[v[j]] += n * (post[k, v] if truth else 1 - post[k, v])
                whole = sum(sums.values())
                rel[j][truth] = {x: s / whole for x, s in sums.items()}
        for k in prior:
            n = sum(c for (q, _), c in counts.items() if q == k)
            prior[k] = (5 + sum(c * post[q, v] for (q, v), c in counts.items() if q == k)) / (10 + n)
    return post, {name: r for name, r in zip(VOTES, rel, strict=True)}


def _marks(row: tuple) -> list[str]:
    kind, a, b, c, size, digits = row[:6]
    return ["one", f"kind={kind}", f"v_regex={a}", f"v_gazetteer={b}", f"v_context={c}", f"size={size}", f"digits={digits}"]


def train(rows: list[tuple], steps: int = 400, rate: float = 0.5, penalty: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier of spans on the cells, with the aggregated votes as soft labels."""
    if not rows:
        return {"one": -10.0}
    post, _ = aggregate_votes(rows)
    total = sum(r[-1] for r in rows)
    weight: dict[str, float] = defaultdict(float)
    data = [(_marks(r), post[r[0], tuple(r[1:4])], r[-1] / total) for r in rows]
    for _ in range(steps):
        slope: dict[str, float] = defaultdict(float)
        for marks, y, n in data:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weight[m] for m in marks)))))
            for m in marks:
                slope[m] += n * (y - p)
        for m, g in slope.items():
            weight[m] += rate * 4 * (g - penalty * weight[m])
    return {m: round(w, 6) for m, w in sorted(weight.items())}


def score(c: Column, weights: dict[str, float]) -> Column:
    """The classifier as an expression; a value that training did not see adds nothing."""
    out = F.lit(weights.get("one", 0.0))
    for name in CELL:
        part = F.lit(0.0)
        for m, w in weights.items():
            if m.startswith(f"{name}="):
                part = F.when(c[name].cast("string") == m.partition("=")[2], w).otherwise(part)
        out = out + part
    return out


def decided(found: DataFrame, weights: dict[str, float]) -> Column:
    """All spans of a row: the base ones and the accepted candidates, by kind as listed, then place."""
    thin = lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))
    return F.concat("__base", F.transform(F.filter("__more", lambda c: score(c, weights) > 0), thin))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def detect(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more (accepted candidates): a row a document."""
    found = materialise(spans(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"]), "pii")
    weights = train(cells(found))
    out = found.withColumn("__all", decided(found, weights))
    count = lambda k: F.size(F.filter("__base", lambda s: s.kind == k)).cast("long")
    return out.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"),
        _joined(F.col("__all")).alias("spans"), (F.size("__all") - F.size("__base")).cast("long").alias("n_more"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, with each span of `text` (overlapping ones as one) replaced by its kind in brackets. Other columns may have any names."""
    row, back = packed(docs)
    found = materialise(spans(docs.select(row, F.col(text).alias("text")), "text", ["row"]), "pii")
    weights = train(cells(found))
    whole = F.col(f"row.c{docs.columns.index(text)}")
    order = F.array_sort(F.transform(decided(found, weights), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    found = found.withColumn("__all", order)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s.start >= acc.at
        piece = F.when(apart, F.concat(F.substring(whole, acc.at + 1, s.start - acc.at), F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.concat(acc.out, piece).alias("out"))

    done = F.aggregate("__all", begin, step, lambda a: F.concat(a.out, F.substring(whole, a.at + 1, F.length(whole))))
    clean = F.when(F.size("__all") > 0, done).otherwise(whole)
    return found.select(*(clean.alias(c) if c == text else b for c, b in zip(docs.columns, back, strict=True)))
