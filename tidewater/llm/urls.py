"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the urls that no rule fits.

Features: lengths of url, host and path, path depth, digit ratio, character entropy, parameter count, host labels, hyphens,
longest run of digits, and how often labelled urls of the same suffix (co.uk, com) are blocked (smoothed) and how many there
are. The trees (logistic loss, histogram splits) are trained from labelled urls: by default those that the rules judge.
Labelled urls with the same features and label are one row with their number. The fit takes a bounded sample, the `sample`
such rows with the smallest hashes; only rows under a hash threshold that lets a few more pass reach the driver. Suffix
statistics use all labelled urls.

No url trains on a suffix rate that its own label, or any label that trains beside the rate, has a part in: a keyed half of the
labelled urls gives the rates that the other half sees in training, and trains itself as if its suffixes were unknown. Urls
are scored with the rates of both halves, with twice the smoothing.

Defined results: null urls and urls without "://" have empty host and path, fit no rule and are scored as they are; repeated
rows are judged each; without labelled urls, or with labels of one kind only, the verdict outside rules is that kind (allow
if there is none). An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernel
from tidewater.llm.common import discard, materialise
from tidewater.session import ready

#: Fixed values: (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rows that a fit takes at most.
SAMPLE = 100_000
#: Urls of the average rate that are added to a suffix.
SMOOTH = 10
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "digit_run")
#: Common second levels of country domains.
SECOND = {"ac", "co", "com", "edu", "gob", "gov", "net", "or", "org"}
_DIGIT = kernel.table(b"0123456789")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return rest[:cut].translate(_LOWER), path[:end]


def match_rule(host: str, path: str, rules) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits."""
    best = None
    for verdict, rule in rules:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def suffix(host: str) -> str:
    """The last label, with the one before it where that is a common second level under a country's."""
    labels = host.partition(":")[0].rsplit(".", 2)
    return ".".join(labels[-2:]) if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND else labels[-1]


def lexical(column, hosts: list[str], paths: list[str]) -> np.ndarray:
    """FEATURES of an Arrow array of urls, a row each; lengths and entropy count UTF-8 bytes."""
    data, offsets = kernel.column_bytes(column)
    rows, n = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(rows), n)
    per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    cell, count = np.unique(row * 256 + data, return_counts=True)
    share = count / n[cell // 256]
    entropy = np.zeros(rows)
    np.add.at(entropy, cell // 256, -share * np.log2(share))
    runs = kernel.Runs(data, offsets, _DIGIT[data])
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, runs.row, runs.end - runs.start)
    queries = [u.split("?", 1)[1].split("#", 1)[0] if u and "?" in u else "" for u in column.to_pylist()]
    parameters = [sum(1 for p in q.split("&") if p) for q in queries]
    depth = [sum(1 for p in x.split("/") if p) for x in paths]
    labels = [h.count(".") + (h != "") for h in hosts]
    digits = per_row(_DIGIT[data]) / np.maximum(n, 1)
    cols = [n, [len(h) for h in hosts], [len(x) for x in paths], depth, digits, np.round(entropy, 9), parameters, labels, per_row(data == 45), longest]
    return np.stack([np.asarray(c, float) for c in cols], axis=1)


class Trees:
    """Gradient-boosted regression trees with logistic loss on at most 64 quantile bins a feature."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, leaf: int = 10, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.leaf, self.penalty = rounds, depth, rate, leaf, penalty
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        """weight: the number of labelled urls that each row stands for."""
        weight = np.ones(len(y)) if weight is None else weight
        if not len(y) or y.min() == y.max():
            self.base = -20.0 if not len(y) or y[0] == 0 else 20.0
            return self
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1], method="lower")) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        rate = (weight * y).sum() / weight.sum()
        self.base = math.log(rate / (1 - rate))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            step = np.zeros(len(y))
            self._grow(tree, bins, weight * (y - p), weight * p * (1 - p), weight, np.arange(len(y)), self.depth, step)
            self.trees.append(tree)
            score += self.rate * step
        return self

    def _grow(self, tree, bins, g, h, weight, rows, depth, step) -> int:
        at = len(tree)
        tree.append(None)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, None, None)
        size = weight[rows].sum()
        if depth and size >= 2 * self.leaf:
            for f, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                b = bins[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=len(edges) + 1))[:-1] for w in (g[rows], h[rows], weight[rows]))
                gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                gain[(nl < self.leaf) | (size - nl < self.leaf)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            value = gs / (hs + self.penalty)
            step[rows] = value
            tree[at] = (-1, 0.0, 0, 0, float(value))
            return at
        _, f, k = best
        left = bins[rows, f] <= k
        a = self._grow(tree, bins, g, h, weight, rows[left], depth - 1, step)
        b = self._grow(tree, bins, g, h, weight, rows[~left], depth - 1, step)
        tree[at] = (f, float(self.edges[f][k]), a, b, 0.0)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the label 1."""
        score = np.full(len(x), self.base)
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            kind, cut, a, b, value = (np.array(c) for c in zip(*tree, strict=True))
            while (inner := kind[node] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(kind[node], 0)] <= cut[node]
                node = np.where(inner, np.where(go, a[node], b[node]), node)
            score += self.rate * value[node]
        return 1 / (1 + np.exp(-score))


def _parse(rules):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            urls = batch.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            found = [match_rule(h, p, rules) for h, p in parts]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            x = lexical(batch.column(1), hosts, paths)
            made = [hosts, paths, [r for r, _ in found], [v for _, v in found], [suffix(h) for h in hosts]]
            cols = [pa.array(c, pa.string()) for c in made]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, flat], names=["page_id", "host", "path", "rule", "ruled", "suffix", "x"])

    return run


def _score(model: Trees, rules: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(5).to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            more = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (6, 7)], axis=1)
            p = model.predict(np.concatenate([x, more], axis=1)) if batch.num_rows else np.empty(0)
            ruled = batch.column(4).to_pylist()
            verdict = [r or ("block" if q > 0.5 else "allow") for r, q in zip(ruled, p.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(verdict, pa.string()), pa.array(np.round(p, 9))], names=["page_id", "host", "path", "rule", "verdict", "block_score"])

    return run


def _half():
    return F.pmod(F.xxhash64("suffix", "x"), F.lit(2))


def suffix_sums(known: DataFrame) -> DataFrame:
    """suffix, s and n (blocked and labelled urls), s0 and n0 (those of the half that gives rates), rows."""
    first = F.when(_half() == 0, F.col("w")).otherwise(0)
    return known.groupBy("suffix").agg(F.sum(F.col("w") * F.col("y")).alias("s"), F.sum("w").alias("n"), F.sum(first * F.col("y")).alias("s0"), F.sum(first).alias("n0"), F.count("*").alias("rows"))


def training_rows(known: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    """suffix, x, y, w with s_rate and s_n as the trees see them in training."""
    rate = F.when(_half() == 1, F.round((F.col("s0") + SMOOTH * prior) / (F.col("n0") + SMOOTH), 9)).otherwise(F.lit(round(prior, 9)))
    joined = known.join(suffixes.select("suffix", "s0", "n0"), "suffix")
    return joined.select("suffix", "x", "y", "w", rate.alias("s_rate"), F.when(_half() == 1, F.log1p("n0")).otherwise(0.0).alias("s_n"))


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id: str = "page_id", url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score: a row a page. labelled: url and block (0 or 1); None: the urls that rules judge."""
    kind = pages.schema[id].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, ruled string, suffix string, x array<double>"
    parse = lambda df: ready(df).mapInArrow(_parse(tuple(rules)), schema)
    parsed = materialise(parse(pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"))), "urls")
    if labelled is None:
        known = parsed.where("ruled is not null").select("suffix", "x", (F.col("ruled") == "block").cast("int").alias("y"))
    else:
        both = labelled.where("block is not null").select(F.col("block").cast("int").alias("page_id"), "url")
        known = ready(both).mapInArrow(_parse(()), schema.replace(f"page_id {kind}", "page_id int")).select("suffix", "x", F.col("page_id").alias("y"))
    known = materialise(known.groupBy("suffix", "x", "y").agg(F.count("*").alias("w")), "known-urls")
    suffixes = suffix_sums(known)
    overall = suffixes.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("suffixes"), F.sum("rows").alias("rows")).first()
    prior = (overall.s / overall.n) if overall.n else 0.5
    few = F.broadcast if overall.suffixes <= 100_000 else lambda side: side
    learnt = training_rows(known.where(_below(F.xxhash64("suffix", "x", "y"), overall.rows or 0, sample)), few(suffixes), prior)
    rows = learnt.orderBy(F.xxhash64("suffix", "x", "y"), "suffix", "x", "y").limit(sample).select("x", "s_rate", "s_n", "y", "w").toArrow()
    flat = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, len(FEATURES))
    at = lambda c: rows.column(c).to_numpy().astype(float)
    model = Trees().fit(np.concatenate([flat, np.stack([at("s_rate"), at("s_n")], axis=1)], axis=1), at("y"), at("w"))
    suffixes = materialise(suffixes, "suffixes")
    discard(known)
    rated = suffixes.select("suffix", F.round((F.col("s") + 2 * SMOOTH * prior) / (F.col("n") + 2 * SMOOTH), 9).alias("s_rate"), F.log1p(F.col("n") / 2).alias("s_n"))
    scored = parsed.join(few(rated), "suffix", "left").withColumns({"s_rate": F.coalesce("s_rate", F.lit(round(prior, 9))), "s_n": F.coalesce("s_n", F.lit(0.0))})
    scored = scored.select("page_id", "host", "path", "rule", "ruled", "x", "s_rate", "s_n")
    return scored.mapInArrow(_score(model, True), f"page_id {kind}, host string, path string, rule string, verdict string, block_score double")


def _below(key, rows: int, sample: int):
    """A condition on a 64-bit hash that about `sample` of `rows` rows and a few more meet; all, if there are no more."""
    wanted = sample + 8 * math.sqrt(sample) + 8
    if wanted >= rows:
        return F.lit(True)
    return key < F.lit(int(-(1 << 63) + (1 << 64) * wanted / rows))
