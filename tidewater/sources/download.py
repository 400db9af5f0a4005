"""Resumable downloads of a manifest: keys whose file is there are skipped, others fetched by bounded threads in each task."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import ready


def _open(url: str, timeout: float) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as r:
        return r.read()


def _put(uri: str, data: bytes) -> None:
    """Under a temporary name, then renamed."""
    from pyarrow import fs

    system, path = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, path)


def fetch(manifest: DataFrame, listing: DataFrame, folder: str, key: str = "name", url: str = "url", concurrency: int = 4, timeout: float = 600.0, opener=_open) -> DataFrame:
    """key, status (ok, skipped, failed), error. listing: name and length of the files of the folder; empty files count as missing."""

    def run(batches):
        import pyarrow as pa

        def one(row):
            try:
                _put(f"{folder}/{row[0]}", opener(row[1], timeout))
                return row[0], "ok", None
            except Exception as e:  # one failure leaves the others alone
                return row[0], "failed", str(e)[:500]

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                out = list(pool.map(one, zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], names=["key", "status", "error"])

    have = listing.where("length > 0").select(F.col("name").alias("__have"))
    rows = ready(manifest).select(F.col(key).alias("__key"), F.col(url).alias("__url"))
    there = rows.join(have, F.col("__key") == F.col("__have"), "left_semi").select(F.col("__key").alias("key"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    todo = rows.join(have, F.col("__key") == F.col("__have"), "left_anti")
    return there.unionAll(todo.mapInArrow(run, "key string, status string, error string"))
