"""Shared helpers: the shared work folder, materialisation, and file access by URI."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints/tidewater"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all runs on one machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = f"file://{LOCAL_CHECKPOINTS}"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut and lost executors cost nothing."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.materialised_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these frames, which nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.materialised_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(taken: list[str], *stems: str) -> list[str]:
    """A column name for each stem that none of the taken ones equals, whatever its case."""
    have, out = {t.lower() for t in taken}, []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in have:
            name, k = f"{stem}_{k}", k + 1
        have.add(name.lower())
        out.append(name)
    return out


def packed(df: DataFrame) -> tuple[Column, list[Column]]:
    """(a struct `row` of all columns under names of its own, the columns taken out of `row` again under theirs)."""
    own = [f"c{i}" for i in range(len(df.columns))]
    row = F.struct(*(F.col(f"`{n}`").alias(o) for n, o in zip(df.columns, own, strict=True))).alias("row")
    return row, [F.col(f"row.{o}").alias(n) for n, o in zip(df.columns, own, strict=True)]


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(the rows, stored with a number of their own each, the column of that number): equal rows can be told apart."""
    (rid,) = fresh(df.columns, "row_number")
    return materialise(df.withColumn(rid, F.monotonically_increasing_id()), name), rid


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def write_committed(uri: str, attempt: str, chunks) -> int:
    """Write byte chunks under a temporary name of this attempt, then rename: a retried task replaces whole files only."""
    system, path = filesystem(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part, size = f"{folder}/.{name}.{attempt}.tmp", 0
    with system.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(part, path)
    return size


def lean(run):
    """A function of batches that gives memory back to the machine when a task ends: Python workers live on, stage after stage."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def within(batch, limit: int = 1 << 21, column: int = 1):
    """Slices of an Arrow batch whose strings in a column hold about `limit` bytes at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
