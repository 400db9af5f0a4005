"""Results that a stream replaces while it goes on, and a final pass over all data that replaces them for good.

A windowed aggregation in update mode gives a window's result again whenever rows of it arrive. Each micro-batch is one commit
that carries its number, so that a batch that runs again adds nothing; of a key's results the one of the latest batch counts.
Rows later than the watermark change no preview: Spark has let go of their windows. They are in the stored events like all
others, and the final pass, which works over those, counts them.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import tables
from tidewater.operators.maintain import fresh

#: Columns of the stored previews beside the results' own.
BATCH, FINAL = "preview_batch", "preview_final"


def previews(results: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Start a query that stores each update of a streaming aggregation. every: a trigger's interval; None: what there is now, then an end."""
    name = sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({BATCH: F.lit(number).cast("long"), FINAL: F.lit(False)})
        tables.Table(batch.sparkSession, path, indexed=[]).append(rows, f"{name}-{number}")

    writer = results.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest result of each key, with preview_final."""
    df = tables.Table(spark, path, indexed=[]).frame()
    (place,) = fresh(df.columns, "place")
    latest = Window.partitionBy(*keys).orderBy(F.desc(BATCH))
    return df.withColumn(place, F.row_number().over(latest)).where(F.col(place) == 1).drop(place, BATCH)


def finish(results: DataFrame, path: str) -> None:
    """Put the results of all data in the previews' place. A reader sees the previews or the final results."""
    rows = results.withColumns({BATCH: F.lit(None).cast("long"), FINAL: F.lit(True)})
    tables.Table(results.sparkSession, path, indexed=[]).replace(rows)
