"""Writers: tables with keyed append, per-language folders, exports, micro-batch append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Types of keys whose smallest and largest value can bound a scan.
BOUNDED = ("tinyint", "smallint", "int", "bigint", "date", "string")


def append(df: DataFrame, path: str, keys: list[str] | None = None, rows_per_file: int = 0, prune: bool = False) -> None:
    """Append to a Parquet table; with keys, rows whose key is already there are left out, so a repeat adds nothing.

    prune: of the stored table only the row groups that meet df's range of the first key are read; df is worked once more for it."""
    spark = df.sparkSession
    from tidewater.operators import tables

    table = tables.Table(spark, path, keys)
    if table.log.entries():  # a table of listed files: one commit
        table.append(df, rows_per_file=rows_per_file)
        return
    if keys:
        try:
            have = spark.read.parquet(path).select(*keys)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            have = None
        df = df.dropDuplicates(keys)
        if have is not None and prune and have.schema[keys[0]].dataType.simpleString() in BOUNDED:
            least, most = df.agg(F.min(keys[0]), F.max(keys[0])).first()
            have = have.where(F.col(keys[0]).between(F.lit(least), F.lit(most)))
        if have is not None:
            df = df.join(have, keys, "left_anti")
    writer = df.write.mode("append")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def pretty_json(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """As json_lines(), each text over several lines with two spaces a level."""
    cols = [c for c in df.columns if c not in drop]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def by_language(df: DataFrame, path: str, column: str = "language") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def json_lines(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text a row, without the dropped columns; nulls stay."""
    cols = [c for c in df.columns if c not in drop]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def append_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Each micro-batch appended by key in one commit that carries its number: a batch that runs again adds nothing, one that is lost leaves nothing."""
    from hashlib import sha256

    from tidewater.operators import tables

    name = sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            tables.Table(batch.sparkSession, path, keys).append(batch, f"{name}-{number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
