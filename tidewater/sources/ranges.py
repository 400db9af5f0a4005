"""Byte ranges of large files, read by seeking: only the bytes that are asked for leave the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewater.session import ready, ship
from tidewater.sources.files import filesystem

PIECE = 1 << 20


def open_at(path: str):
    """A file that can be read at any place."""
    system, at = filesystem(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(at)


def read_ranges(df: DataFrame, path: str = "path", start: str = "start", length: str = "length", data: str = "data") -> DataFrame:
    """df with the bytes [start, start + length) of the file at each row's path; fewer where the file ends, null where a value is null.

    Rows of one file that follow one another share its handle. A missing file is an error."""
    names = df.columns
    at = [names.index(c) for c in (path, start, length)]

    def run(batches):
        import pyarrow as pa

        held, file = None, None
        for b in batches:
            out = []
            for p, a, n in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                if p is None or a is None or n is None:
                    out.append(None)
                    continue
                if p != held:
                    if file is not None:
                        file.close()
                    held, file = p, open_at(p)
                n = max(0, min(n, file.size() - a))
                out.append(file.read_at(n, a) if n else b"")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, data])
        if file is not None:
            file.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return ready(df).mapInArrow(run, f"{kinds}, `{data}` binary")


def store_blobs(rows: DataFrame, key: str, content: str, folder: str) -> DataFrame:
    """key, path, start, length: binary contents laid one after another in files, one a partition, and where each lies. Null contents have length null."""

    def run(batches):
        import uuid

        import pyarrow as pa

        uri = f"{folder}/{uuid.uuid4().hex}.blob"
        system, at = filesystem(uri)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        place = 0
        with system.open_output_stream(at, compression=None) as out:
            for b in batches:
                starts, sizes = [], []
                for x in b.column(1).to_pylist():
                    starts.append(place)
                    sizes.append(None if x is None else len(x))
                    out.write(x or b"")
                    place += len(x or b"")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([uri] * b.num_rows), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=[key, "path", "start", "length"])

    kind = rows.schema[key].dataType.simpleString()
    placed = ready(rows).select(key, F.col(content).cast("binary")).mapInArrow(run, f"`{key}` {kind}, path string, start long, length long")
    placed.write.parquet(f"{folder}/places")  # stored once: a second run would lay the contents down again
    return rows.sparkSession.read.parquet(f"{folder}/places")


class Piece(InputPartition):
    def __init__(self, start: int, length: int):
        self.start, self.length = start, length


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.piece = options["path"], int(options.get("piece", PIECE))
        self.first, self.last = int(options.get("start", 0)), options.get("end")

    def partitions(self):
        with open_at(self.path) as f:
            end = min(f.size(), int(self.last)) if self.last is not None else f.size()
        return [Piece(a, min(self.piece, end - a)) for a in range(self.first, end, self.piece)] or [Piece(self.first, 0)]

    def read(self, partition):
        if partition.length > 0:
            with open_at(self.path) as f:
                yield partition.start, f.read_at(partition.length, partition.start)


class ByteRanges(DataSource):
    """spark.read.format("byte_ranges"): start, data of a file's bytes [start, end), a partition a piece (options path, start, end, piece)."""

    @classmethod
    def name(cls):
        return "byte_ranges"

    def schema(self):
        return "start long, data binary"

    def reader(self, schema):
        return _Reader(self.options)


def read_blob(spark: SparkSession, path: str, start: int = 0, end: int | None = None, piece: int = PIECE) -> DataFrame:
    """start, data: a row a piece of a file's bytes [start, end)."""
    ship(spark)
    spark.dataSource.register(ByteRanges)
    reader = spark.read.format("byte_ranges").option("path", path).option("start", start).option("piece", piece)
    return (reader if end is None else reader.option("end", end)).load()
