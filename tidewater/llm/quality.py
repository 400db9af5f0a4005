"""Quality rules: per-text statistics and robust multivariate outliers.

Each text gets word, symbol and repetition counts. The transformed counts of the texts of one language and source are judged
by a minimum-covariance-determinant estimate: of all subsets that hold the `support` share of a group's rows, the one whose
scatter has the smallest determinant gives centre and scatter. The search takes many starts at once, keyed by (group, start):
the coordinate-wise medians, and centres and scatters of a few rows drawn by keyed hashes. Concentration steps re-estimate
from the rows with the smallest Mahalanobis distances; the best few starts go on until their determinants stop falling, and
the smallest wins. Rows within the 97.5 % cutoff of that estimate give the reweighted one. All of it runs over all rows, as
DataFrame aggregations on distinct vectors with their numbers. A row whose distance exceeds the chi-square cutoff is rejected.

Many of these statistics are zero in most texts, so that plain scatters would be singular: the scatter of a subset is
regularised, c S + T with a fixed diagonal T (`FEATURES`), as in the minimum regularised covariance determinant; concentration
steps never raise that determinant either. With target=None T is zero.

The subset is exact. Distances that agree to about one ten-millionth are ties, and ties at the subset's edge share the places
that are left (equal rows are alike, whichever of them are counted).

Estimates of a group of n rows are drawn to those of its language with the weight SHRINK / (n + SHRINK), and those of a
language likewise to those of the whole table; so a group of any size has an estimate, and no size is treated otherwise.

Defined results: a null text is an empty text; null language or source are values of their own. Repeated rows count each
time. A row's verdict depends on its text, language and source alone, whatever its id. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import kernel
from tidewater.llm.common import discard, fresh, lean, materialise, packed, within
from tidewater.session import ready

SYMBOLS = kernel.table(b"#*$%&|<>")
#: Fixed-point scale of the transformed statistics: their sums are exact integers, so any order of addition gives one result.
SCALE = 1000
#: Transformed statistics and the least spread (in their own units) that the scatter is given in that direction.
FEATURES = {"x_chars": 0.15, "x_symbols": 0.25, "x_lines": 0.10, "x_repeat": 0.10}
_D = len(FEATURES)
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_stats(column):
    """Counts of an Arrow string array."""
    data, offsets = kernel.column_bytes(column)
    rows = len(column)
    words = kernel.Runs(data, offsets, ~kernel.SPACE[data])
    n_words = np.diff(words.of)
    hasher = kernel.Hasher(data)
    per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    chars = per_row(~kernel.SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = per_row(SYMBOLS[data])
    lines = kernel.Runs(data, offsets, data != 10)
    has_word = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    ends, row = lines.end[has_word], lines.row[has_word]
    dup = kernel.surplus(hasher(lines.start[has_word], ends), row, rows)
    shingle, at = kernel.windows(hasher(words.start, words.end), words.of, 8)
    again = kernel.repeated(shingle, words.row[at])
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + 8, -1)
    covered = np.cumsum(edge[:-1]) > 0
    repeat = np.bincount(words.row[covered], minlength=rows)
    return [n_words, chars, symbols, dup, repeat, np.bincount(row, minlength=rows)]


def _counted(first: str, text):
    """mapInArrow function: the columns but for a text of its own, and the counts. text: function of a batch."""

    def run(batches):
        import pyarrow as pa

        names = [first, "lang", "source"]
        for whole in batches:
            joined = pa.RecordBatch.from_arrays([text(whole), *(whole.column(n) for n in names)], names=["text", *names])
            for batch in within(joined, column=0):
                cols = [pa.array(x.astype(np.int64)) for x in text_stats(batch.column(0))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *cols], names=[*names, *(x.split()[0] for x in BASE.split(", "))])

    return run


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a document: its id, language and source under the names doc_id, lang, source, and the counts of BASE."""
    pick = ready(docs).select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    kind = pick.schema["doc_id"].dataType.simpleString()
    return pick.mapInArrow(lean(_counted("doc_id", lambda b: b.column("text"))), f"doc_id {kind}, lang string, source string, {BASE}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def transformed() -> dict[str, Column]:
    fixed = lambda x: F.round(F.coalesce(x, F.lit(0.0)) * SCALE).cast("long")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "x_chars": fixed(F.log(F.greatest(share("word_chars", "n_words"), F.lit(0.1)))),
        "x_symbols": fixed(F.log1p(100 * share("n_symbols", "word_chars"))),
        "x_lines": fixed(share("n_dup_lines", "n_lines")),
        "x_repeat": fixed(share("n_repeat_words", "n_words")),
    }


def chi2_quantile_even(p: float, dof: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom."""
    sf = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - sf(mid) < p else (lo, mid)
    return lo


def consistency(support: float) -> float:
    """Factor that makes the scatter of the `support` share nearest the centre that of all rows, for normal data."""
    if support >= 1:
        return 1.0
    q = chi2_quantile_even(support, _D)
    sf = math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range((_D + 2) // 2))
    return support / (1 - sf)


_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
_SUMS = [*(f"s{i}" for i in range(_D)), *(f"p{i}{j}" for i, j in _PAIRS)]
_MODEL = [*(f"m{i}" for i in range(_D)), *(f"v{i}{j}" for i, j in _PAIRS)]
_SCATTER = [f"c{i}{j}" for i, j in _PAIRS]
_X = [f"x{i}" for i in range(_D)]


def _doubles(names: list[str]) -> str:
    return ", ".join(f"{c} double" for c in names)


#: Exact sums of the vectors and of their products, by the number of their rows. SQL text: one call a plan node, not one an operation.
_MOMENTS = [*(f"sum(w * {x}) as s{i}" for i, x in enumerate(_X)), *(f"sum(w * {_X[i]} * {_X[j]}) as p{i}{j}" for i, j in _PAIRS)]


def _exprs(texts: list[str]) -> list[Column]:
    return [F.expr(t) for t in texts]


def _full(flat: np.ndarray) -> np.ndarray:
    """Symmetric matrices of rows of upper triangles."""
    out = np.empty((len(flat), _D, _D))
    for k, (i, j) in enumerate(_PAIRS):
        out[:, i, j] = out[:, j, i] = flat[:, k]
    return out


def _flat(full: np.ndarray) -> np.ndarray:
    return np.stack([full[:, i, j] for i, j in _PAIRS], axis=1)


def _inverse(scatter: np.ndarray) -> np.ndarray:
    """Inverses; of singular scatters those of their range, with any step out of it very far."""
    values, axes = np.linalg.eigh(scatter)
    return np.einsum("nik,nk,njk->nij", axes, 1 / np.maximum(values, 1e-12), axes)


def _estimates(factor: float, target: np.ndarray):
    """mapInPandas function: keys, n and sums -> keys, n, log-determinant, centre, scatter and inverse scatter."""

    def run(frames):
        import pandas as pd

        for f in frames:
            n = f["n"].to_numpy(float)[:, None]
            mean = f[_SUMS[:_D]].to_numpy(float) / n / SCALE
            cov = _full(f[_SUMS[_D:]].to_numpy(float) / n / SCALE**2) - mean[:, :, None] * mean[:, None, :]
            scatter = np.round(factor * cov + np.diag(target), 12)
            sign, det = np.linalg.slogdet(scatter)
            out = f[["grp", "start", "n"]].copy()
            out["det"] = np.round(np.where(sign > 0, np.maximum(det, -200.0), -200.0), 9)
            values = np.concatenate([np.round(mean, 9), _flat(scatter), _flat(_inverse(scatter))], axis=1)
            yield pd.concat([out.reset_index(drop=True), pd.DataFrame(values, columns=[*_MODEL[:_D], *_SCATTER, *_MODEL[_D:]])], axis=1)

    return run


_ESTIMATE = f"grp string, start int, n double, det double, {_doubles([*_MODEL[:_D], *_SCATTER, *_MODEL[_D:]])}"


def _distance(x: list[str]) -> str:
    """Squared Mahalanobis distance of vectors (in units of SCALE) by the columns of a model, as SQL text."""
    d = [f"({c} / {SCALE}D - m{i})" for i, c in enumerate(x)]
    return "greatest(0D, " + " + ".join(f"{1 if i == j else 2}D * {d[i]} * {d[j]} * v{i}{j}" for i, j in _PAIRS) + ")"


#: Cells of distances per factor e, and parts of a cell.
_COARSE, _FINE = 8, 1 << 20


def _sized(groups: DataFrame, n: int) -> DataFrame:
    """A hint for a side of n checked rows."""
    return F.broadcast(groups) if n <= 100_000 else groups


def _concentrate(vectors: DataFrame, models: DataFrame, rows: int, support: float, exact: bool) -> DataFrame:
    """grp, start, n and sums of the `support` share of each group's rows that is nearest by each model.

    Order statistics come from cells of distances, at most some hundred by (group, start); exact: the edge cell is cut again
    into fine parts. A cell or part at the edge enters with the share of it that fills the subset."""
    of = ["grp", "start"]
    side = _sized(models.select(*of, *_MODEL), rows)
    near = vectors.join(side, "grp").selectExpr(*of, "w", *_X, f"ln(greatest({_distance(_X)}, 1e-9D)) * {_COARSE} as at")
    near = near.selectExpr("*", "cast(floor(at) as int) as cell")
    cells = near.groupBy(*of, "cell").agg(*_exprs(["sum(w) as n", *_MOMENTS]))
    before = "coalesce(sum(n) over (partition by grp, start order by cell rows between unbounded preceding and 1 preceding), 0)"
    cells = cells.selectExpr("*", f"{before} as before", f"ceil({support}D * sum(n) over (partition by grp, start)) as h")
    if not exact:
        return _filled(cells, of)
    inner = cells.where("before + n < h").groupBy(*of).agg(*_exprs([f"sum({c}) as {c}" for c in ("n", *_SUMS)]))
    edge = cells.where("before < h and before + n >= h").selectExpr(*of, "cell as edge", "before", "h")
    cut = near.join(_sized(edge, rows), of).where("cell = edge")
    cut = cut.selectExpr(*of, f"cast(least(floor((at - cell) * {_FINE}), {_FINE - 1}) as int) as cell", "before as first", "h", "w", *_X)
    cut = cut.groupBy(*of, "cell", "first", "h").agg(*_exprs(["sum(w) as n", *_MOMENTS])).selectExpr("*", f"first + {before} as before")
    both = _filled(cut, of).unionByName(inner.selectExpr(*of, *(f"cast({c} as double) as {c}" for c in ("n", *_SUMS))))
    return both.groupBy(*of).agg(*_exprs([f"sum({c}) as {c}" for c in ("n", *_SUMS)]))


def _filled(cells: DataFrame, of: list[str]) -> DataFrame:
    """Sums of the cells before the edge and of the share of the edge cell that fills the subset: one cell a group at most is shared."""
    whole, share = "before + n <= h", "(h - before) / n"
    # whole cells add up exactly; max takes the one shared cell
    some = [f"coalesce(cast(sum(case when {whole} then {c} end) as double), 0D) + coalesce(max(case when not {whole} then {c} * {share} end), 0D) as {c}" for c in ("n", *_SUMS)]
    return cells.where("before < h").groupBy(*of).agg(*_exprs(some))


def _drawn(vectors: DataFrame, starts: int) -> DataFrame:
    """grp, start, n and sums of _D + 1 rows for each start, each the winner of a race of keyed hashes among the group's rows."""
    many = vectors.selectExpr("*", f"explode(sequence(1, {starts})) as start")
    of, picks = ", ".join(_X), []
    for k in range(_D + 1):
        race = f"-ln((pmod(xxhash64({of}, start, {k}), 1L << 52) + 0.5D) / {float(1 << 52)}D) / w"
        picks.append(f"min_by(struct({of}), struct(round({race}, 12), {of})) as d{k}")
    rows = many.groupBy("grp", "start").agg(*_exprs(picks)).selectExpr("grp", "start", f"explode(array({', '.join(f'd{k}' for k in range(_D + 1))})) as d")
    return rows.selectExpr("grp", "start", "1L as w", "d.*").groupBy("grp", "start").agg(*_exprs(["sum(w) as n", *_MOMENTS]))


def _middle(vectors: DataFrame) -> DataFrame:
    """m0..: the coordinate-wise medians (the lower ones) of each group, from counts of values."""
    cells = vectors.select("grp", "w", F.posexplode(F.array(*_X)).alias("feature", "x")).groupBy("grp", "feature", "x").agg(F.sum("w").alias("n"))
    run, whole = Window.partitionBy("grp", "feature").orderBy("x"), Window.partitionBy("grp", "feature")
    mid = cells.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(whole)).where(2 * F.col("upto") >= F.col("all"))
    mid = mid.groupBy("grp", "feature").agg((F.min("x") / SCALE).alias("m"))
    return mid.groupBy("grp").agg(*(F.max(F.when(F.col("feature") == i, F.col("m"))).alias(f"m{i}") for i in range(_D)))


def mcd(
    vectors: DataFrame, support: float = 0.75, starts: int = 12, keep: int = 3, steps: int = 30, target: list[float] | None = list(FEATURES.values()), reweight: float | None = 0.975
) -> DataFrame:
    """vectors: grp, x0.. (whole numbers, in units of 1 / SCALE) and w, the number of rows, materialised.

    One row a group: grp, n (rows of the subset), det (log-determinant of its scatter), m0.. (centre), c00.. (scatter) and v00.. (its inverse)."""
    target = np.zeros(_D) if target is None else np.array(target) ** 2
    factor = consistency(support)
    spread = np.maximum(target, 1e-6)
    fixed = {f"v{i}{j}": F.lit(float(1 / spread[i]) if i == j else 0.0) for i, j in _PAIRS}
    first = _middle(vectors).select("grp", F.lit(0).alias("start"), *(f"m{i}" for i in range(_D)), *(c.alias(k) for k, c in fixed.items()))
    drawn = _drawn(vectors, starts).withColumn("n", F.col("n").cast("double")).mapInPandas(_estimates(1.0, spread), _ESTIMATE).select("grp", "start", *_MODEL)
    models = materialise(first.unionByName(drawn), "mcd")
    made = [models]

    def step(models: DataFrame, rows: int, exact: bool) -> DataFrame:
        return _concentrate(vectors, models, rows, support, exact).mapInPandas(_estimates(factor, target), _ESTIMATE)

    rows = models.count()
    for _ in range(2):
        models = materialise(step(models, rows, False), "mcd")
        made.append(models)
    # the best starts of each group, until no determinant falls any more
    order = Window.partitionBy("grp").orderBy("det", "start")
    live = models.withColumn("place", F.row_number().over(order)).where((F.col("place") <= keep) | (F.col("start") == 0)).drop("place")
    best = None
    for k in range(steps):
        now = step(live, rows, True)
        old = live.select("grp", "start", F.col("det").alias("was"))
        # the first of these steps has no exact subset to be compared with
        falls = F.col("det") < F.col("was") - 1e-7 if k else F.lit(True)
        state = materialise(now.join(_sized(old, rows), ["grp", "start"]).withColumn("falls", falls).drop("was"), "mcd")
        made.append(state)
        best = state if best is None else best.unionByName(state)
        live = state.where("falls").drop("falls")
        if not state.agg(F.bool_or("falls")).first()[0]:
            break
    least = best.groupBy("grp").agg(F.min(F.struct("det", "start", *(c for c in best.columns if c not in ("grp", "det", "start", "falls")))).alias("b")).select("grp", "b.*").drop("start")
    if reweight:
        cut = chi2_quantile_even(reweight, _D)
        least = materialise(least, "mcd")
        made.append(least)
        near = vectors.join(_sized(least.select("grp", *_MODEL), rows), "grp").where(f"{_distance(_X)} <= {cut}D")
        sums = near.groupBy("grp").agg(*_exprs(["cast(sum(w) as double) as n", *_MOMENTS])).withColumn("start", F.lit(0))
        least = sums.mapInPandas(_estimates(consistency(reweight), target), _ESTIMATE).drop("start")
    out = materialise(least, "mcd")
    discard(*made)
    return out


#: Rows that a group's language (and a language's table) stands for in its estimate.
SHRINK = 40


def _shrunk():
    """mapInPandas function: own, language's and table's estimates with their numbers of rows -> centre and inverse scatter."""

    def run(frames):
        import pandas as pd

        for f in frames:
            part = lambda p: (f[[f"{p}m{i}" for i in range(_D)]].to_numpy(float), f[[f"{p}{c}" for c in _SCATTER]].to_numpy(float))
            mean, scatter = part("t_")
            for p in ("l_", "o_"):
                n = f[f"{p}rows"].to_numpy(float)[:, None]
                share = n / (n + SHRINK)
                m, c = part(p)
                mean, scatter = share * m + (1 - share) * mean, share * c + (1 - share) * scatter
            values = np.concatenate([np.round(mean, 9), _flat(_inverse(_full(scatter)))], axis=1)
            yield pd.concat([f[["fine"]].reset_index(drop=True), pd.DataFrame(values, columns=_MODEL)], axis=1)

    return run


def models(vectors: DataFrame, **options) -> DataFrame:
    """vectors: fine, pool, x0.., w. fine, m0.., v00..: the estimate of each group, drawn to its language's and the table's."""
    level = F.explode(F.array(F.concat(F.lit("o:"), "fine"), F.concat(F.lit("l:"), "pool"), F.lit("t:")))
    every = vectors.select(level.alias("grp"), *_X, "w").groupBy("grp", *_X).agg(F.sum("w").alias("w"))
    every = materialise(every, "quality-levels")
    fit = mcd(every, **options)
    groups = vectors.groupBy("fine", "pool").agg(F.sum("w").alias("o_rows"))
    pools = vectors.groupBy("pool").agg(F.sum("w").alias("l_rows"))
    named = lambda p: fit.select(F.col("grp").alias(f"{p}grp"), *(F.col(c).alias(f"{p}{c}") for c in [*_MODEL[:_D], *_SCATTER]))
    out = groups.join(pools, "pool")
    for p, key in (("o_", F.concat(F.lit("o:"), "fine")), ("l_", F.concat(F.lit("l:"), "pool")), ("t_", F.lit("t:"))):
        out = out.withColumn(f"{p}grp", key).join(named(p), f"{p}grp")
    out = materialise(out.mapInPandas(_shrunk(), f"fine string, {_doubles(_MODEL)}"), "quality-models")
    discard(every, fit)
    return out


def judged(stats: DataFrame, tail: float = 1e-5, **options) -> DataFrame:
    """stats: lang, source, the counts of BASE and any further columns, materialised. With base_failed, distance (squared) and kept."""
    mine = fresh(stats.columns, "fine", "pool", *_X)
    fine, pool, xs = mine[0], mine[1], mine[2:]
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    full = stats.withColumns({"base_failed": base_failed(), pool: key("lang"), fine: F.concat_ws("\x00", key("lang"), key("source")), **dict(zip(xs, transformed().values(), strict=True))})
    good = full.where(~F.col("base_failed")).groupBy(F.col(fine).alias("fine"), F.col(pool).alias("pool"), *(F.col(x).alias(y) for x, y in zip(xs, _X, strict=True))).agg(F.count("*").alias("w"))
    good = materialise(good, "quality-vectors")
    fit = models(good, **options)
    side = _sized(fit.withColumnRenamed("fine", fine), fit.count())
    out = full.join(side, fine, "left").withColumn("distance", F.expr(_distance(xs)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi2_quantile_even(1 - tail, _D)))
    discard(good)
    return out.select(*stats.columns, "base_failed", "distance", "kept")


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tail: float = 1e-5, **options) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, distance (squared; null where no group has a row that passes the base rules) and kept, a row a document."""
    stats = materialise(statistics(docs, id, text, lang, source), "quality-stats")
    out = judged(stats, tail, **options)
    return out.select("doc_id", "lang", "source", *(x.split()[0] for x in BASE.split(", ")), "base_failed", "distance", "kept")


def clean(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", tail: float = 1e-5, **options) -> DataFrame:
    """The rows of docs, all columns, that the rules keep, each judged by itself: ids are not looked at, other columns may have any names."""
    row, back = packed(docs)
    pick = ready(docs).select(row, F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    kind = pick.schema["row"].dataType.simpleString()
    at = f"c{docs.columns.index(text)}"
    stats = materialise(pick.mapInArrow(lean(_counted("row", lambda b: b.column("row").field(at))), f"row {kind}, lang string, source string, {BASE}"), "quality-stats")
    out = judged(stats, tail, **options).where("kept")
    return out.select(*back)
