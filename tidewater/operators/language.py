"""The language of media files: three samples a file, a vote, and files moved into folders by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import lookup, media
from tidewater.operators import maintain
from tidewater.session import ready

#: Places of the samples, as multiples of the first one.
MULTIPLES = (1.0, 3.0, 5.0)


def samples(files: DataFrame, probe, clip, path: str = "path", seconds: float = 30.0, offset: float = 60.0) -> DataFrame:
    """path, sample, label, probability, error: a row a file and place.

    clip(path, start, seconds) gives a piece of sound (None or empty: there is none), probe(piece) a label and its probability.
    What either raises is the row's error. A file's samples may lie in different tasks."""

    def run(batches):
        import pyarrow as pa

        def one(p, i):
            try:
                piece = clip(p, offset * MULTIPLES[i], seconds)
                if piece is None or not len(piece):
                    return None, None, "no sound"
                label, share = probe(piece)
                return label, float(share), None
            except Exception as e:  # one failure leaves the others alone
                return None, None, str(e)[:500] or type(e).__name__

        for b in batches:
            got = [one(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["path", "sample", "label", "probability", "error"])

    places = files.select(F.col(path).alias("path"), F.explode(F.array(*(F.lit(i) for i in range(len(MULTIPLES))))).alias("sample"))
    return ready(places).mapInArrow(run, "path string, sample int, label string, probability double, error string")


def detect(files: DataFrame, probe, clip, path: str = "path", seconds: float = 30.0, offset: float = 60.0) -> DataFrame:
    """path, status (ok, failed), language, probability, error: a row a distinct path.

    The label with the largest sum of probabilities (the first seen of equals), mapped to a two-letter code where there is one; the
    probability is that sum over the number of samples asked for. A file without any usable sample has failed, with its first error."""
    heard = samples(files.select(path).distinct(), probe, clip, path, seconds, offset)
    folder = maintain.work_folder(files.sparkSession, "heard")
    heard.write.parquet(folder)  # each sample is probed once
    heard = files.sparkSession.read.schema(heard.schema).parquet(folder)
    won = maintain.vote(heard.where("label is not null"), ["path"], "label", "probability", "sample", len(MULTIPLES))
    errors = heard.where("label is null").groupBy("path").agg(F.min(F.struct("sample", "error")).error.alias("error"))
    every = heard.select("path").distinct().join(won, "path", "left").join(errors, "path", "left")
    ok = F.col("label").isNotNull()
    return every.select("path", F.when(ok, "ok").otherwise("failed").alias("status"), lookup.language(F.col("label")).alias("language"), "probability", F.when(~ok, F.col("error")).alias("error"))


def moves(detected: DataFrame, folder: str) -> DataFrame:
    """path, target: where each file belongs. This alone is the dry run."""
    target = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("language"), F.lit("/"), media.basename(F.col("path")))
    return detected.where("status = 'ok'").select("path", target.alias("target"))


def move(planned: DataFrame) -> DataFrame:
    """path, target, status (moved, there, failed), error: files moved by tasks. A file that is at its target already is left there, so a repeat does no harm."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        from tidewater.sources.files import filesystem

        def one(a, b):
            try:
                (system, src), (_, dst) = (filesystem(p if "://" in p or p.startswith("file:") else f"file://{p}") for p in (a, b))
                here, there = (system.get_file_info(p).type == fs.FileType.File for p in (src, dst))
                if there:
                    return ("there", None) if not here or src == dst else ("failed", "the target is there")
                system.create_dir(dst.rpartition("/")[0], recursive=True)
                system.move(src, dst)
                return "moved", None
            except Exception as e:  # one failure leaves the others alone
                return "failed", str(e)[:500]

        for b in batches:
            got = [one(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))], names=["path", "target", "status", "error"])

    done = ready(planned).select("path", "target").mapInArrow(run, "path string, target string, status string, error string")
    folder = maintain.work_folder(planned.sparkSession, "moves")
    done.write.parquet(folder)
    return planned.sparkSession.read.schema(done.schema).parquet(folder)
