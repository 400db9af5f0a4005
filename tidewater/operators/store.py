"""A store of tables in folders: opening, bulk ingest, adding and dropping columns, compaction with swap."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import ingest, maintain, tables
from tidewater.operators.commits import path_of as _files
from tidewater.sources import sinks

KEYS = ["doc_id", "speech_id", "chunk_id"]


@dataclass
class Store:
    """Tables by name. frame() reads one."""

    spark: SparkSession
    path: str
    names: list[str] = field(default_factory=list)

    def table(self, name: str) -> DataFrame:
        return tables.read(self.spark, f"{self.path}/{name}")

    def health(self, pings: dict | None = None) -> DataFrame:
        """name, n_rows, ok: a row a table, and one a service (n_rows null); a ping is a function that raises or returns falsely when its service is down."""
        out = None
        for name in self.names:
            part = self.table(name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(True).alias("ok"))
            out = part if out is None else out.unionAll(part)
        up = []
        for name, ping in sorted((pings or {}).items()):
            try:
                up.append((name, None, bool(ping())))
            except Exception:  # a service that is down is a row, not an error
                up.append((name, None, False))
        services = self.spark.createDataFrame(up, "name string, n_rows long, ok boolean")
        return services if out is None else out.unionAll(services)


def open_store(spark: SparkSession, path: str, required: tuple[str, ...] = ("chunks",)) -> Store:
    """The store in a folder, one table a subfolder; without a required table it is an error."""
    system, at = _files(spark, path)
    names = sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()) if system.exists(at) else []
    names = [n for n in names if not n.startswith((".", "_"))]
    gone = [n for n in required if n not in names]
    if gone:
        raise FileNotFoundError(f"{path} has no table {', '.join(gone)}")
    return Store(spark, path, names)


def ingest_many(
    transcripts: DataFrame, path: str, metadata: DataFrame | None = None, language: str | None = None,
    base_uri: str | None = None, root: str | None = None, thumbnails: DataFrame | None = None,
) -> int:
    """Append the chunks of transcripts by key, and their documents if a base, root or thumbnails are given. The number of chunks; none is an error."""
    rows = ingest.chunks(transcripts, metadata, language)
    n = rows.count()
    if not n:
        raise ValueError("the transcripts have no chunks")
    sinks.append(rows, f"{path}/chunks", KEYS)
    if base_uri or root or thumbnails is not None:
        sinks.append(ingest.documents(transcripts, metadata, base_uri, root, thumbnails, language), f"{path}/documents", ["doc_id"])
    return n


def add_column(spark: SparkSession, path: str, name: str, make) -> bool:
    """Rewrite a table with one more column, which `make` (a function of the frame) gives or which is an expression. False, and nothing done, if it is there."""
    df = tables.read(spark, path)
    if name in df.columns:
        return False
    replace_table(df.withColumn(name, make) if isinstance(make, Column) else make(df), path)
    return True


def drop_columns(spark: SparkSession, path: str, names: list[str]) -> list[str]:
    """Rewrite a table without columns that nothing reads any more. Those that were there."""
    df = tables.read(spark, path)
    dead = [n for n in names if n in df.columns]
    if dead:
        replace_table(df.drop(*dead), path)
    return dead


def replace_table(df: DataFrame, path: str, rows: int | None = None) -> None:
    """Put df, which may read the table, in the place of all rows of a table.

    The new files count from the moment at which one entry of the table's log names them; a run that is lost before leaves the
    old table. Readers that go by the log (tables.read, Store.table) see the old table or the new one. The old files go
    afterwards; those of a run that is lost before that are left to the table's vacuum()."""
    table = tables.Table(df.sparkSession, path, indexed=[])
    table._adopt()
    old = table.files()
    table.replace(df.repartition(max(1, -(-df.count() // rows))) if rows else df)
    table.discard(old)
    df.sparkSession.catalog.refreshByPath(path)


def compact(spark: SparkSession, path: str, rows: int = 1 << 20, indexes: dict | None = None) -> dict:
    """Rewrite a table in place into files of about `rows` rows. Then rebuild indexes: column -> function of the frame, only where the column has no nulls."""
    before = tables.read(spark, path)
    counts = {"rows": before.count(), "files_before": len(before.inputFiles())}
    replace_table(before, path, rows)
    now = tables.read(spark, path)
    counts |= {"files_after": len(now.inputFiles()), "rebuilt": [], "skipped": []}
    for column, build in sorted((indexes or {}).items()):
        if column in now.columns and now.where(F.col(column).isNull()).isEmpty():
            build(now)
            counts["rebuilt"].append(column)
        else:
            counts["skipped"].append(column)
    return counts


def run_job(todo: DataFrame, make, path: str, keys: list[str], payload: str, batch: int = 2000, everything: bool = False) -> DataFrame:
    """A resumable job: rows whose key the table at `path` has not are given to `make` (a function of frames: keys and results), empty results are dropped, the rest appended in one commit.

    everything: rows whose key is there are worked again and appended as well. status, n: ok, failed and skipped rows. At most `batch` rows a file."""
    spark = todo.sparkSession
    table = tables.Table(spark, path, [] if everything else keys, indexed=keys[:1])
    table._adopt()
    rest, skipped = todo, 0
    if not everything and table.files():
        have = table.frame().select(*keys)
        rest, skipped = todo.join(have, keys, "left_anti"), todo.join(have, keys, "left_semi").count()
    made = make(rest)
    side = maintain.work_folder(spark, "job")
    made.write.parquet(side)
    made = spark.read.schema(made.schema).parquet(side)
    good = made.where(F.coalesce(F.octet_length(payload), F.lit(0)) > 0)
    n, ok = made.count(), good.count()
    if ok:
        table.append(good, rows_per_file=batch)
    system, at = _files(spark, side)
    system.delete(at, True)
    return spark.createDataFrame([("failed", n - ok), ("ok", ok), ("skipped", skipped)], "status string, n long")


def frame_job(
    chunks: DataFrame, listing: DataFrame, make, path: str, root: str | None = None, keys: list[str] | None = None,
    payload: str = "frame_blob", everything: bool = False, limit: int = 0, batch: int = 2000,
) -> DataFrame:
    """One picture a chunk: chunks without one (all with `everything`; the first `limit` by key for a trial) get their source resolved
    against root, `make` (frame of keys, start, source -> keys, payload ...) extracts, and what it gives is appended.

    status, n: ok, failed, missing (no source) and skipped (there already) rows."""
    spark, keys = chunks.sparkSession, keys or KEYS
    table = tables.Table(spark, path, keys)
    table._adopt()
    rows, skipped = chunks.select(*keys, "audio_path", "start"), 0
    if not everything and table.files():
        n = rows.count()
        rows = table.missing(rows)
        skipped = n - rows.count()
    if limit > 0:
        rows = rows.orderBy(*keys).limit(limit)
    found, counts = maintain.resolve(rows, listing, root)
    gone = counts.first().missing
    done = {r.status: r.n for r in run_job(found, make, path, keys, payload, batch, everything).collect()}
    return spark.createDataFrame([("failed", done["failed"]), ("missing", gone), ("ok", done["ok"]), ("skipped", skipped)], "status string, n long")
