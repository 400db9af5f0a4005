"""Maintenance of stored tables: backfill, resume, merge, compaction, health; voting and sharding."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir; a local one where all runs on one machine and it is unset)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = "file:///tmp/checkpoints/tidewater"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def fresh(taken: list[str], *stems: str) -> list[str]:
    """A name for each stem that no column of a table has, whatever its case."""
    have, out = {t.lower() for t in taken}, []
    for stem in stems:
        while stem.lower() in have:
            stem += "_"
        have.add(stem.lower())
        out.append(stem)
    return out


def missing(df: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet; repeats stay."""
    return df.join(have.select(*keys), keys, "left_anti")


def merge(table: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Update-only merge: rows with an update take its columns, updates without a row are ignored. Of updates of one key the largest counts."""
    (new,) = fresh(table.columns, "new")
    best = updates.groupBy(*keys).agg(F.max(F.struct(*columns)).alias(new))
    out = table.join(best, keys, "left")
    taken = lambda c: F.when(F.col(new).isNotNull(), F.col(f"{new}.{c}")).otherwise(F.col(c)).alias(c)
    return out.select(*(taken(c) if c in columns else F.col(c) for c in table.columns))


def backfill(table: DataFrame, keys: list[str], column: str, make, only_null: bool = True) -> DataFrame:
    """Fill a column by a vectorised function (frame of the rows in question -> keys and column) and merge it back."""
    todo = table.where(F.col(column).isNull()) if only_null else table
    return merge(table, make(todo), keys, [column])


def resolve(df: DataFrame, listing: DataFrame, root: str | None = None, path: str = "audio_path", file: str = "path") -> tuple[DataFrame, DataFrame]:
    """(rows with their `source`, counts of found and missing rows). listing: a row a file that is there.

    A row's file is the one at its path as it is, or at root/path where the path is relative and a root is given. Schemes
    (file:), doubled slashes and single dots do not matter. Files of the same name elsewhere are not it."""
    own, key, src = fresh([*df.columns, *listing.columns, "source"], "own", "key", "src")
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "(?:/[.]?(?=/))+", "")
    wanted = F.col(path)
    if root is not None:
        wanted = F.when(F.startswith(wanted, F.lit("/")), wanted).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), wanted))
    files = listing.groupBy(plain(F.col(file)).alias(key)).agg(F.min(file).alias(src))
    out = df.withColumn(own, plain(wanted)).join(files, F.col(own) == F.col(key), "left")
    out = out.withColumn("source", F.col(src)).drop(own, key, src)
    counts = out.agg(F.count_if(F.col("source").isNotNull()).alias("found"), F.count_if(F.col("source").isNull()).alias("missing"))
    return out.where("source is not null"), counts


def status_histogram(df: DataFrame, status: str, key: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def status_keys(df: DataFrame, status: str, key: str, first: int) -> DataFrame:
    """status, n, keys: rows by status with their smallest keys in order, `first` of them at most. Tasks cut their lists before the shuffle (Spark limits window groups where they arise)."""
    (place,) = fresh([status, key], "place")
    rows = df.select(status, key)
    few = rows.withColumn(place, F.row_number().over(Window.partitionBy(status).orderBy(key))).where(F.col(place) <= first)
    keys = few.groupBy(status).agg(F.sort_array(F.collect_list(key)).alias("keys"))
    counts = rows.groupBy(status).agg(F.count("*").alias("n"))
    return counts.join(keys.withColumnRenamed(status, place), F.col(status).eqNullSafe(F.col(place)), "left").select(status, "n", "keys")


def outcome(df: DataFrame, status: str, key: str, error: str, first: int = 5) -> DataFrame:
    """status, n, failures: rows by status, and for failed ones the first few keys (by key) with their errors."""
    few = df.where(F.col(status) == "failed").orderBy(key).limit(first).agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.col(error).alias("error")))).alias("failures"))
    counts = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(few)).withColumn("failures", F.when(F.col("status") == "failed", F.col("failures")))  # one row


def queue(df: DataFrame, status: str = "status") -> DataFrame:
    """queued, done, error, processed: one row."""
    of = lambda *names: F.count_if(F.col(status).isin(*names))
    return df.agg(of("queued").alias("queued"), of("done").alias("done"), of("error").alias("error"), of("done", "error").alias("processed"))


def vote(df: DataFrame, item: list[str], label: str, probability: str, order: str, samples: int = 3) -> DataFrame:
    """The label with the largest sum (first seen of equals) and that sum divided by the number of samples asked for."""
    sums = df.groupBy(*item, label).agg(F.sum(probability).alias("s"), F.min(order).alias("seen"))
    best = sums.groupBy(*item).agg(F.max_by(F.struct(label, "s"), F.struct("s", (-F.col("seen")).alias("o"))).alias("b"))
    return best.select(*item, F.col(f"b.{label}").alias(label), (F.col("b.s") / samples).alias("probability"))


def shard(df: DataFrame, name: list[Column], n: int) -> DataFrame:
    """Round-robin shard numbers over sorted names: rows are sorted in ranges, whose sizes give each range's first number."""
    spark, folder = df.sparkSession, work_folder(df.sparkSession, "ranges")
    part, start = fresh(df.columns, "range", "start")
    order = Window.partitionBy(part).orderBy(*name)
    df.repartitionByRange(*name).withColumn(part, F.spark_partition_id()).write.parquet(folder)  # stored: ranges are the same whenever they are read
    ranges = spark.read.parquet(folder)
    sizes = sorted(tuple(r) for r in ranges.groupBy(part).agg(F.count("*")).collect())  # a row a range
    starts, at = [], 0
    for k, size in sizes:
        starts.append((k, at))
        at += size
    placed = ranges.join(F.broadcast(spark.createDataFrame(starts, f"`{part}` int, `{start}` long")), part)
    return placed.withColumn("shard", ((F.row_number().over(order) - 1 + F.col(start)) % n).cast("int")).drop(part, start)


def compact(spark: SparkSession, source: str, target: str, rows: int = 1 << 20) -> dict[str, int]:
    """Rewrite a table into files of about `rows` rows. Files before and after, rows."""
    df = spark.read.parquet(source)
    n = df.count()
    before = len(df.inputFiles())
    df.repartition(max(1, -(-n // rows))).write.mode("overwrite").parquet(target)
    return {"rows": n, "files_before": before, "files_after": len(spark.read.parquet(target).inputFiles())}


def clustered(df: DataFrame, path: str, keys: list[str]) -> None:
    """Store sorted by key ranges, so that lookups by key skip files and row groups."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows: a row a table."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = part if out is None else out.unionAll(part)
    return out


def page(df: DataFrame, keys: list[str], number: int = 1, per_page: int = 24) -> DataFrame:
    return df.orderBy(*keys).offset(max(0, (number - 1) * per_page)).limit(per_page)


def pages(total: Column, per_page: int = 24) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / per_page))
