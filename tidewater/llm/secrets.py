"""Secret scans with a ledger of blobs: each content is scanned once by each version of a rule, wherever and whenever it occurs.

A history is a table with a row a historical version of a file (path, commit, anything else) and its text. Texts are addressed
by SHA-256. The ledger holds, by address, which rules in which versions have seen a blob, and what they found. A scan looks up
the addresses of a history, takes one text of each blob that some current rule has not seen, lets only the missing rules read
it, and adds both to the ledger in one commit. Findings are joined back to every row whose text has the address. All of it is
DataFrame functions.

Places come without any per-text loop: a pattern's matches and the parts between them are turned into rows with their lengths,
and a running sum gives where each match stands. Patterns are written so that Java's matcher needs neither recursion nor
repeated scans of long runs.

Defined results: null texts are empty (no spans); places count code points; repeated rows and copies share one blob; a blob
without findings is known to the ledger all the same. Rows keep all their columns, whatever their names. An empty table gives
an empty result and commits nothing. A run that is lost before its commit leaves nothing that counts; two scans at a time may
both scan a blob, whose equal findings count once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import fresh, materialise
from tidewater.operators.commits import Log


@dataclass(frozen=True)
class Rule:
    """matches: all that a rule looks at, leftmost and without overlaps; a match counts if its `group` has `least` characters.

    needs: a text that a text with a match must hold, cheap to find. A changed rule gets a new version, and is run again."""

    kind: str
    version: int
    matches: str
    least: int = 1
    group: int = 0
    needs: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules.
BASE = (
    Rule("assign", 1, r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", 8, 1),
    Rule("access", 1, r"AKIA([A-Z0-9]++)", 12, 1, ("AKIA",)),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)
#: Published shapes of keys and tokens.
EXTRA = (
    Rule("private_key", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=,:\x20\x0A\x0D-]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----", needs=("PRIVATE KEY",)),
    Rule("code_host", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}", needs=("gh",)),
    Rule("chat", 1, r"xox[abeprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyJ",)),
    Rule("payment", 1, r"[rs]k_live_[A-Za-z0-9]{16,}", needs=("k_live_",)),
    Rule("cloud_api", 1, r"AIza[A-Za-z0-9_-]{35}", needs=("AIza",)),
    Rule("url_login", 1, r"://[^\x00-\x20/:@?#]{1,64}:[^\x00-\x20/:@?#]{1,64}@", needs=("://",)),
)
RULES = BASE + EXTRA

SPAN = "struct<kind:string,rule:string,start:bigint,end:bigint>"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _lengths(rule: Rule, text: Column, wanted: Column) -> Column:
    """For each match of a rule: (characters before it since the last match, its characters, those of its group). Null where the rule is not asked or nothing matches."""
    held = wanted
    for n in rule.needs:
        held = held & F.contains(text, F.lit(n))
    held = held & text.rlike(rule.matches)
    size = lambda a: F.transform(a, F.length)
    whole = size(F.regexp_extract_all(text, F.lit(rule.matches), F.lit(0)))
    group = size(F.regexp_extract_all(text, F.lit(rule.matches), F.lit(rule.group))) if rule.group else whole
    gaps = size(F.slice(F.split(text, rule.matches, -1), F.lit(1), F.size(whole)))
    return F.when(held, F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), group.alias("part")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """blobs: blob, text, missing (names of the rules to run). ((blob, rules) of all, (blob, kind, rule, start, end) of what was found)."""
    asked = lambda r: F.array_contains("missing", r.name)
    lengths = [_lengths(r, F.col("text"), asked(r)).alias(f"l{i}") for i, r in enumerate(rules)]
    seen = materialise(blobs.select("blob", F.col("missing").alias("rules"), *lengths), "secrets-seen")
    some = F.coalesce(*(f"l{i}" for i in range(len(rules)))).isNotNull()
    each = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.name).alias("rule"), F.lit(r.least).alias("least"), F.col(f"l{i}").alias("l")) for i, r in enumerate(rules)))
    rows = seen.where(some).select("blob", F.inline(each)).select("blob", "kind", "rule", "least", F.posexplode("l").alias("pos", "m"))
    rows = rows.select("blob", "kind", "rule", "least", "pos", *(F.col(f"m.{n}").cast("long").alias(n) for n in ("gap", "whole", "part")))
    from pyspark.sql import Window

    so_far = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(so_far)).where(F.col("part") >= F.col("least"))
    return seen.select("blob", "rules"), found.select("blob", "kind", "rule", (F.col("end") - F.col("whole")).alias("start"), "end")


class Ledger:
    """A ledger in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        if len({r.name for r in rules}) < len(rules):
            raise ValueError("two rules have one name and version")
        self.spark, self.path, self.rules, self.log = spark, path.rstrip("/"), tuple(rules), Log(spark, path)

    def _read(self, what: str, schema: str) -> DataFrame:
        """What committed batches hold."""
        paths = [f"{self.path}/{what}/{e['batch']}" for e in self.log.entries()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        """blob, rules: which versions of rules have read it; a blob may have several rows."""
        return self._read("seen", "blob string, rules array<string>")

    def found(self) -> DataFrame:
        """blob, kind, rule, start, end, each once, of the current versions of the rules."""
        rows = self._read("found", "blob string, kind string, rule string, start long, end long")
        return rows.where(F.col("rule").isin([r.name for r in self.rules])).distinct()

    def scan(self, history: DataFrame, text: str = "text") -> dict[str, int]:
        """Scan what some rule has not seen. Blobs scanned now, and findings added."""
        every = F.array(*(F.lit(r.name) for r in self.rules))
        texts = history.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        if self.log.entries():
            known = self.seen().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("have"))
            todo = texts.select("blob").distinct().join(known, "blob", "left")
            todo = todo.select("blob", F.array_except(every, F.coalesce("have", F.array().cast("array<string>"))).alias("missing")).where(F.size("missing") > 0)
            todo = materialise(todo, "secrets-todo")
            one = texts.join(todo.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]).join(todo, "blob")
        else:
            one = texts.dropDuplicates(["blob"]).withColumn("missing", every)  # a task's copies of a text are one before any shuffle
        seen, found = scan_blobs(one, self.rules)
        counts = {"blobs": seen.count(), "findings": 0}
        if counts["blobs"]:
            batch = uuid.uuid4().hex
            seen.write.parquet(f"{self.path}/seen/{batch}")
            found.write.parquet(f"{self.path}/found/{batch}")
            counts["findings"] = self.spark.read.parquet(f"{self.path}/found/{batch}").count()
            self.log.commit({"batch": batch, "rules": [r.name for r in self.rules], **counts})
        return counts

    def spans_by_blob(self) -> DataFrame:
        """blob, spans (sorted by start, kind as listed, end): a row a blob with findings."""
        order = F.create_map(*(x for i, k in enumerate(dict.fromkeys(r.kind for r in self.rules)) for x in (F.lit(k), F.lit(i))))
        one = F.struct("start", order[F.col("kind")].alias("place"), "end", "kind", "rule")
        spans = self.found().groupBy("blob").agg(F.array_sort(F.collect_list(one)).alias("spans"))
        return spans.select("blob", F.transform("spans", lambda s: F.struct(s.kind.alias("kind"), s.rule.alias("rule"), s.start.alias("start"), s.end.alias("end"))).alias("spans"))

    def join_back(self, history: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str, str]:
        """(the columns `keep` of every row, or all but the text, with its address and spans; the names of these two)."""
        keep = [c for c in history.columns if c != text] if keep is None else keep
        blob, spans = fresh(keep, "blob", "spans")
        rows = history.select(*(F.col(f"`{c}`") for c in keep), address(F.col(text)).alias(blob))
        have = self.spans_by_blob().select(F.col("blob").alias(blob), F.col("spans").alias(spans))
        out = rows.join(have, blob, "left")
        none = F.array().cast(f"array<{SPAN}>")
        return out.select(*(F.col(f"`{c}`") for c in keep), blob, F.coalesce(spans, none).alias(spans)), blob, spans


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digest(docs: DataFrame, ledger: Ledger, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_more, blob: a row a document, from the ledger."""
    rows, blob, spans = ledger.join_back(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"])
    base = F.filter(spans, lambda s: s.kind.isin([r.kind for r in BASE]))
    count = lambda k: F.size(F.filter(spans, lambda s: s.kind == k)).cast("long")
    return rows.select(
        "doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col(spans)).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_more"), blob,
    )
