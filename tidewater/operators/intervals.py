"""Joins of times with intervals, by key and time bucket: what is compared within a key grows with a bucket, not with the key's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(t: Column, seconds: int) -> Column:
    """The first microsecond of a time's bucket."""
    at = F.unix_micros(t.cast("timestamp"))
    return at - F.pmod(at, F.lit(seconds * 1_000_000).cast("long"))


def _met(times: DataFrame, intervals: DataFrame, on: list[str], t: str, start: str, end: str, seconds: int) -> DataFrame:
    """Pairs of times and intervals of one key whose buckets meet: each pair once, as a time has one bucket."""
    name, taken = "__bucket", {c.lower() for c in times.columns + intervals.columns}
    while name in taken:
        name += "_"
    covered = F.sequence(_bucket(F.col(start), seconds), _bucket(F.col(end), seconds), F.lit(seconds * 1_000_000).cast("long"))
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(covered))
    return times.withColumn(name, _bucket(F.col(t), seconds)).join(spread, [*on, name]).drop(name)


def points(times: DataFrame, intervals: DataFrame, on: list[str], t: str, start: str, end: str, seconds: int = 3600) -> DataFrame:
    """Rows of times with each interval of their key with start <= t < end.

    seconds: width of a bucket, about an interval's usual length; an interval is a row in each bucket that it covers, and any width
    gives the same rows. Null keys and null times match nothing, repeated rows match each."""
    return _met(times, intervals, on, t, start, end, seconds).where((F.col(start) <= F.col(t)) & (F.col(t) < F.col(end)))


def inside(inner: DataFrame, outer: DataFrame, on: list[str], inner_start: str, inner_end: str, start: str, end: str, seconds: int = 3600) -> DataFrame:
    """Intervals with each interval of their key that contains them, both ends included; reversed ones are in none. Widths, nulls and repeats as in points()."""
    met = _met(inner.where(F.col(inner_start) <= F.col(inner_end)), outer, on, inner_start, start, end, seconds)
    return met.where((F.col(inner_start) >= F.col(start)) & (F.col(inner_end) <= F.col(end)))
