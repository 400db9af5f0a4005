"""Tables of listed files: a table is what its commit log lists, so that every change appears whole or not at all.

A change writes new files beside the old ones and then adds one entry to the log: files added, files taken away. Readers read
listed files only. Appends carry the name of their batch, so that a batch that runs again adds nothing. A merge, a relabelling
and a compaction rewrite only the files that hold rows in question. For indexed columns each file has its range of values and
a Bloom filter, by which a lookup opens only files that may hold its keys.

A folder of Parquet files without a log can be read as a table; its files are listed when it is changed for the first time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from tidewater.operators.commits import Conflict, Log, path_of

#: Bits of a Bloom filter a row, and hashes a value: one of a hundred values that are not there passes.
BITS, HASHES = 10, 4
#: Bits of one bitmap of Spark.
MAP = 32_768
#: Keys up to which Bloom filters are asked; for more, only ranges.
LOOKUP = 1000
#: How often a change is tried again after other writers.
TRIES = 5


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table in a folder, with a log or without."""
    table = Table(spark, path)
    return table.frame() if table.log.entries() else spark.read.parquet(path)


def _fresh(taken: list[str], stem: str) -> str:
    have, name = {t.lower() for t in taken}, stem
    while name.lower() in have:
        name += "_"
    return name


def _decoded(uri: Column) -> Column:
    """A URI without its escapes."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


class Table:
    """keys: what tells rows apart; indexed: columns with ranges and Bloom filters; partition: a column of which a file holds one value."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, indexed: list[str] | None = None, partition: str | None = None):
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, path)
        self.keys, self.indexed, self.partition = keys or [], indexed if indexed is not None else (keys or [])[:1], partition

    # --- what is there

    def state(self) -> tuple[int, dict[str, int]]:
        """(number of entries, rows of each file that is listed)."""
        live: dict[str, int] = {}
        entries = self.log.entries()
        for e in entries:
            for f in e["remove"]:
                live.pop(f, None)
            live.update({f: n for f, n in e["add"]})
        return len(entries), live

    def files(self) -> list[str]:
        return sorted(self.state()[1])

    def schema(self) -> types.StructType:
        import json

        kept = [e["schema"] for e in self.log.entries() if e.get("schema")]
        if not kept:
            raise FileNotFoundError(f"{self.path} has no table")
        return types.StructType.fromJson(json.loads(kept[-1]))

    def frame(self, files: list[str] | None = None) -> DataFrame:
        """All rows, or those of some files."""
        files, schema = self.files() if files is None else files, self.schema()
        if not files:
            return self.spark.createDataFrame([], schema)
        whole: dict[str, set] = {}
        for e in self.log.entries():
            for f, _ in e["add"]:
                whole.setdefault("/".join(f.split("/")[:2]), set()).add(f)
        wanted, paths = set(files), []
        for folder, own in whole.items():
            if folder.startswith("data/") and own <= wanted:
                paths.append(folder)  # a folder instead of all of its files
                wanted -= own
        read = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        return read.parquet(*(f"{self.path}/{p}" for p in [*paths, *sorted(wanted)]))

    # --- changes

    def _listed(self, folder: str) -> list[str]:
        """Data files under a folder, relative to the table."""
        system, at = path_of(self.spark, f"{self.path}/{folder}" if folder else self.path)
        if not system.exists(at):
            return []
        out, found, root = [], system.listFiles(at, bool(folder)), system.makeQualified(at).toUri().getPath().rstrip("/")
        while found.hasNext():
            name = found.next().getPath().toUri().getPath()[len(root) + 1 :]
            if not name.rpartition("/")[2].startswith(("_", ".")):
                out.append(f"{folder}/{name}" if folder else name)
        return sorted(out)

    def _write(self, df: DataFrame, batch: str, rows_per_file: int = 0) -> list[list]:
        """[file, rows] of a frame written under the batch's name, with ranges and Bloom filters of the indexed columns."""
        folder = f"data/{batch}"
        writer = df.write
        if self.partition:
            part = _fresh(df.columns, "part")
            writer = df.withColumn(part, F.col(self.partition)).write.partitionBy(part)
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(f"{self.path}/{folder}")
        if not self._listed(folder):
            return []
        rows = self.spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{folder}")
        name, file = F.regexp_extract(_decoded(F.col("_metadata.file_path")), f"/(data/{batch}/.*)$", 1), "file"
        cols = {c: f"c{i}" for i, c in enumerate(self.indexed)}
        thin = rows.select(name.alias(file), *(F.col(f"`{c}`").alias(n) for c, n in cols.items()))
        ranges = thin.groupBy(file).agg(F.count("*").alias("n"), *(f(n).alias(f"{k}_{n}") for n in cols.values() for k, f in (("min", F.min), ("max", F.max))))
        ranges.withColumn("maps", F.ceil(F.col("n") * BITS / MAP).cast("int")).write.parquet(f"{self.path}/_index/{batch}/ranges")
        ranges = self.spark.read.schema(self._range_schema(df.schema)).parquet(f"{self.path}/_index/{batch}/ranges")
        found = {r[0]: r[1] for r in ranges.select(file, "n").collect()}  # a row a file
        some = [self._places(thin.join(F.broadcast(ranges.select(file, "maps")), file), F.col(n)).select(F.lit(c).alias("column"), file, "map", "place") for c, n in cols.items()]
        if some:
            bits = some[0]
            for x in some[1:]:
                bits = bits.unionAll(x)
            bits.groupBy("column", file, "map").agg(F.bitmap_construct_agg("place").alias("bits")).write.parquet(f"{self.path}/_index/{batch}/bits")
        return [[f, found.get(f, 0)] for f in self._listed(folder)]

    @staticmethod
    def _places(rows: DataFrame, value: Column) -> DataFrame:
        """A row for each hash of each value: the number of the bitmap, the place in it. rows have `maps`, the bitmaps of their file."""
        size = F.col("maps").cast("long") * MAP
        every = F.explode(F.array(*(F.pmod(F.xxhash64(value, F.lit(i)), size) for i in range(HASHES))))
        rows = rows.where(value.isNotNull()).withColumn("bit", every)
        return rows.select("*", F.floor(F.col("bit") / MAP).cast("int").alias("map"), (F.col("bit") % MAP).alias("place"))

    def _commit(self, op: str, batch: str, add: list, remove: list[str], number: int, schema: types.StructType) -> None:
        self.log.commit({"batch": batch, "op": op, "add": add, "remove": remove, "schema": schema.json()}, number)

    def _adopt(self) -> None:
        """List the files of a folder that has no log yet."""
        if self.log.entries():
            return
        files = self._listed("")
        system, at = path_of(self.spark, self.path)
        if system.exists(at) and any(x.isDirectory() and not x.getPath().getName().startswith(("_", ".")) and x.getPath().getName() != "data" for x in system.listStatus(at)):
            raise ValueError(f"{self.path} has folders of its own; a table of listed files must begin empty or flat")
        if files:
            df = self.spark.read.parquet(self.path)
            sizes = {r[0].rpartition("/")[2]: r[1] for r in df.groupBy(F.col("_metadata.file_path")).count().collect()}
            self._commit("adopt", "adopted", [[f, sizes.get(f, 0)] for f in files], [], 0, df.schema)

    def append(self, df: DataFrame, batch: str | None = None, rows_per_file: int = 0, files: int = 0) -> int:
        """Add rows; with keys, only those whose key is not there, one a key. The number of rows; 0 if the batch was added before.

        files: deal the rows into so many files by ranges of keys; 0: as they come."""
        batch = batch or uuid.uuid4().hex
        self._adopt()
        if self.log.has(batch):
            return 0
        if self.keys:
            df = self.missing(df.dropDuplicates(self.keys))
        if files:
            df = self._dealt(df, files)
        # files of a run that was lost between writing and its entry lie under another attempt's name
        own = f"{batch}-{uuid.uuid4().hex[:8]}"
        add = self._write(df, own, rows_per_file)
        for _ in range(TRIES):
            number, _ = self.state()
            if self.log.has(batch):
                return 0
            try:
                self.log.commit({"batch": batch, "op": "append", "add": add, "remove": [], "schema": df.schema.json()}, number)
                return sum(n for _, n in add)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: other writers came first {TRIES} times")

    def missing(self, df: DataFrame) -> DataFrame:
        """Rows of df whose key is not there; of the table only the keys of files that may hold them are read."""
        if not self.files():
            return df
        files = self.holding(df)
        return df.join(self.frame(files).select(*self.keys), self.keys, "left_anti") if files else df

    def holding(self, df: DataFrame) -> list[str]:
        """Files that may hold keys of df, by the first key if it is indexed."""
        if not self.keys or self.keys[0] not in self.indexed:
            return self.files()
        few = df.select(self.keys[0]).distinct().limit(LOOKUP + 1).collect()
        if len(few) <= LOOKUP:
            return self.candidates(self.keys[0], [r[0] for r in few])
        least, most = df.agg(F.min(self.keys[0]), F.max(self.keys[0])).first()
        return self.between(self.keys[0], least, most)

    def _ranges(self, column: str) -> tuple[DataFrame | None, list[str], str]:
        """(ranges of files that have them, listed files without, the column's name there)."""
        live = self.files()
        batches = sorted({f.split("/")[1] for f in live if f.startswith("data/")})
        bare = [f for f in live if not f.startswith("data/")]
        if not batches:
            return None, bare, ""
        ranges = self.spark.read.schema(self._range_schema(self.schema())).parquet(*(f"{self.path}/_index/{b}/ranges" for b in batches))
        return ranges, bare, f"c{self.indexed.index(column)}"

    def _range_schema(self, schema: types.StructType) -> types.StructType:
        out = types.StructType().add("file", types.StringType()).add("n", types.LongType())
        for i, c in enumerate(self.indexed):
            out = out.add(f"min_c{i}", schema[c].dataType).add(f"max_c{i}", schema[c].dataType)
        return out.add("maps", types.IntegerType())

    def between(self, column: str, least, most) -> list[str]:
        """Listed files whose range of values meets another; files without ranges count."""
        ranges, bare, c = self._ranges(column)
        live = set(self.files())
        if ranges is None or least is None:
            return bare if least is not None else []
        hit = ranges.where((F.col(f"min_{c}") <= F.lit(most)) & (F.col(f"max_{c}") >= F.lit(least))).select("file")
        return sorted([*bare, *(r[0] for r in hit.collect() if r[0] in live)])

    def candidates(self, column: str, values: list) -> list[str]:
        """Listed files that may hold one of the values, by range and Bloom filter; files without them count."""
        values = [v for v in values if v is not None]
        ranges, bare, c = self._ranges(column)
        if ranges is None or not values:
            return bare if values else []
        live = set(self.files())
        kind = self.schema()[column].dataType
        asked = ranges.withColumn("value", F.explode(F.array(*(F.lit(v).cast(kind) for v in values)))).where(F.col("value").between(F.col(f"min_{c}"), F.col(f"max_{c}")))
        places = self._places(asked.select("file", "maps", "value"), F.col("value"))
        batches = sorted({f.split("/")[1] for f in live if f.startswith("data/")})
        bits = self.spark.read.schema("column string, file string, map int, bits binary").parquet(*(f"{self.path}/_index/{b}/bits" for b in batches)).where(F.col("column") == column)
        byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("place") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        is_set = F.floor(byte / F.pow(F.lit(2), F.col("place") % 8)) % 2 == 1
        met = places.join(bits, ["file", "map"]).groupBy("file", "value").agg(F.count_if(is_set).alias("met")).where(F.col("met") == HASHES)
        return sorted([*bare, *(r[0] for r in met.select("file").distinct().collect() if r[0] in live)])

    def lookup(self, column: str, values: list) -> DataFrame:
        """Rows with one of the values; only files that may hold them are opened."""
        return self.frame(self.candidates(column, values)).where(F.col(column).isin(values))

    def _rewrite(self, op: str, touched: list[str], make, schema: types.StructType | None = None) -> dict[str, int]:
        """Put what `make` gives for the rows of some files in these files' place."""
        number, live = self.state()
        counts = {"files": len(live), "rewritten": len(touched)}
        if touched:
            batch = uuid.uuid4().hex
            df = make(self.frame(touched))
            self._commit(op, batch, self._write(df, batch), touched, number, schema or self.schema())
        return counts

    def _touched(self, keys: DataFrame) -> list[str]:
        """Files that do hold a key of the frame: the keys of files that may hold one are read, and no other column."""
        may = self.holding(keys)
        if not may:
            return []
        system, at = path_of(self.spark, self.path)
        root = system.makeQualified(at).toUri().getPath().rstrip("/")
        rows = self.frame(may).select(*self.keys, _decoded(F.col("_metadata.file_path")).alias(_fresh(self.keys, "file")))
        found = rows.join(keys.select(*self.keys).distinct(), self.keys, "left_semi").select(rows.columns[-1]).distinct().collect()
        return sorted(r[0].rpartition(f"{root}/")[2] for r in found)

    def _dealt(self, df: DataFrame, files: int) -> DataFrame:
        """As many parts as there were files, sorted by key."""
        return df.repartitionByRange(max(1, files), *self.keys).sortWithinPartitions(*self.keys)

    def merge(self, updates: DataFrame, columns: list[str]) -> dict[str, int]:
        """Rows with an update take its columns; updates without a row are ignored. Files without such a row stay as they are.

        files, rewritten: how many there were, and how many were written anew. Another writer in between is a Conflict."""
        from tidewater.operators.maintain import merge

        self._adopt()
        touched = self._touched(updates)
        return self._rewrite("merge", touched, lambda rows: self._dealt(merge(rows, updates, self.keys, columns), len(touched)))

    def relabel(self, labels: DataFrame) -> dict[str, int]:
        """labels: keys and a new value of the partition column. Files of rows that do not move are left alone, and so are all files of the partitions they move to."""
        self._adopt()
        c = self.partition
        new = _fresh([*self.schema().names, *labels.columns], "label")
        moves = labels.select(*self.keys, F.col(c).alias(new))
        own = self.frame(self.holding(labels)).select(*self.keys, c).join(moves, self.keys).where(~F.col(c).eqNullSafe(F.col(new)))
        touched = self._touched(own.select(*self.keys))
        return self._rewrite("relabel", touched, lambda rows: rows.join(moves, self.keys, "left").withColumn(c, F.coalesce(new, c)).select(*rows.columns))

    def compact(self, rows: int = 1 << 20) -> dict[str, int]:
        """Put files of fewer than half of `rows` rows together in files of about `rows`."""
        self._adopt()
        _, live = self.state()
        small = sorted(f for f, n in live.items() if 2 * n < rows)
        if len(small) < 2:
            return {"files": len(live), "rewritten": 0}
        n = -(-sum(live[f] for f in small) // rows)
        return self._rewrite("compact", small, lambda df: self._dealt(df, n) if self.keys and not self.partition else df.repartition(max(1, n), *([self.partition] if self.partition else [])))

    def replace(self, df: DataFrame, rows_per_file: int = 0) -> None:
        """Put a frame, which may read the table, in the place of all rows. Columns may change."""
        self._adopt()
        number, live = self.state()
        batch = uuid.uuid4().hex
        self._commit("replace", batch, self._write(df, batch, rows_per_file), sorted(live), number, df.schema)

    def discard(self, files: list[str]) -> None:
        """Delete files that are listed no more."""
        live, system = set(self.files()), path_of(self.spark, self.path)[0]
        for f in files:
            if f not in live:
                system.delete(path_of(self.spark, f"{self.path}/{f}")[1], False)

    def vacuum(self) -> int:
        """Delete files that are not listed: of earlier states and of lost runs. Only when nobody reads or writes the table. How many."""
        live = set(self.files())
        dead = [f for f in self._listed("") + self._listed("data") if f not in live]
        self.discard(dead)
        return len(dead)
