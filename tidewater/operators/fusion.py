"""Rank fusion of result lists and reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(hits: DataFrame, number: int, order: list[Column]) -> DataFrame:
    """A top-k list with its list number and 0-based rank."""
    return hits.withColumns({"__list": F.lit(number), "__rank": F.row_number().over(Window.partitionBy(F.lit(number)).orderBy(*order)) - 1})


def rrf(lists: list[DataFrame], keys: list[str], k: int = 60, carry: list[str] | None = None) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (k + rank) by key over all lists; the first-seen row stands for its key.

    lists: frames from ranked(). keys: the columns that identify a hit; rows of one list with equal keys add as well."""
    carry = carry or []
    every = reduce(DataFrame.unionByName, (x.select(*keys, *carry, "__list", "__rank") for x in lists))
    first = F.min(F.struct("__list", "__rank", *carry)).alias("__f")
    out = every.groupBy(*keys).agg(F.round(F.sum(1 / (k + F.col("__rank"))), 9).alias("_relevance_score"), first)
    return out.select(*keys, *(F.col(f"__f.{c}").alias(c) for c in carry), "_relevance_score", F.col("__f.__list").alias("__list"), F.col("__f.__rank").alias("__rank"))


def order(keys: list[str]) -> list:
    """Best first; ties by first list, first rank, key."""
    return [F.desc("_relevance_score"), "__list", "__rank", *keys]


def best(fused: DataFrame, n: int, keys: list[str], marks: bool = False) -> DataFrame:
    """The n best; marks: with the columns that break ties."""
    out = fused.orderBy(*order(keys)).limit(n)
    return out if marks else out.drop("__list", "__rank")


def linear(text_hits: DataFrame, vector_hits: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """weight * (1 - distance) + (1 - weight) * score / best score over the union; a missing branch gives 0."""
    # text_hits is a top-k list, so one window over it is small
    top = text_hits.select(*keys, "_score", F.max("_score").over(Window.partitionBy(F.lit(0))).alias("__top"))
    a = top.select(*keys, (F.col("_score") / F.col("__top")).alias("__a"), F.lit(None).cast("double").alias("__b"))
    b = vector_hits.select(*keys, F.lit(None).cast("double").alias("__a"), (1 - F.col("_distance")).alias("__b"))
    both = a.unionByName(b).groupBy(*keys).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    score = weight * F.coalesce("__b", F.lit(0.0)) + (1 - weight) * F.coalesce("__a", F.lit(0.0))
    return both.select(*keys, F.round(score, 6).alias("_relevance_score"))


def overlap_score(text: Column, terms: list[str]) -> Column:
    """A deterministic relevance: the Jaccard similarity of the text's words and the query's terms."""
    from tidewater.functions import text as T

    own, q = F.array_distinct(T.tokens(text)), F.array(*(F.lit(t) for t in dict.fromkeys(terms)))
    return F.round(F.size(F.array_intersect(own, q)) / F.size(F.array_union(own, q)), 6)


def rerank(hits: DataFrame, scorer, prior: list[Column], cap: int = 100) -> DataFrame:
    """The best `cap` rows by prior order, scored again by a column expression (or a vectorised function of the frame)."""
    kept = hits.orderBy(*prior).limit(cap)
    kept = scorer(kept) if callable(scorer) else kept.withColumn("_relevance_score", scorer)
    return kept.orderBy(F.desc("_relevance_score"), *prior)
