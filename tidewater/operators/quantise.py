"""An inverted-file index with product quantisation, for batches of queries.

Cells and codebooks are fitted by Lloyd's rounds, each a job: tasks add up the vectors nearest to each centre, Spark adds up the
tasks' sums, and only centres (cells x dimensions numbers) pass the driver. The fit reads a bounded sample (the rows with the
smallest hashes of their keys) or, with sample=None, all rows. Every row is indexed: its cell, and for each part of its unit
vector's offset from the cell's centre the nearest code of that part.

A search turns queries into (query, cell) rows for their `nprobes` nearest cells, which tasks store in blocks by cell. The codes
of probed cells are read once; for each stretch of a cell's codes a task reads that cell's blocks of queries, one at a time,
ranks by inner products read from a table per query, and keeps the best `refine` x k a query. These are ranked again by their
exact vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.maintain import work_folder
from tidewater.operators.vector import QUERIES, cosine_distance, keep_best, matrix, nearest_of, ranked_nearest, unit
from tidewater.session import ready
from tidewater.sources import files

#: Codes of a cell that are compared at a time.
STRETCH = 1 << 16
#: Candidates up to which they are broadcast to the exact vectors.
FEW = 1_000_000


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


def _means(rows: DataFrame, assign, old: np.ndarray) -> np.ndarray:
    """New centres: `assign` gives for a matrix of vectors (number of the centre, vector) arrays. A centre that loses all its rows stays."""

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros(old.shape), np.zeros(len(old), np.int64)
        for b in batches:
            if b.num_rows:
                of, x = assign(unit(matrix(b.column(0))))
                np.add.at(total, of, x)
                n += np.bincount(of, minlength=len(old))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["i", "n", "s"])

    sums = rows.mapInArrow(run, "i int, n long, s array<double>").select("i", "n", F.posexplode("s").alias("j", "s"))
    out = old.copy()
    for r in sums.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # centres x dimensions
        out[r.i, r.j] = r.s / r.n
    return out


class IVFPQ:
    """build(), then search(). Integer keys; a column with nulls is refused, as its rows would never be found."""

    def __init__(self, cells: int = 256, subvectors: int = 64, codes: int = 256, sample: int | None = 262_144, rounds: int = 8, seed: int = 42):
        if codes > 256:
            raise ValueError("a code is one byte")
        self.cells, self.subvectors, self.n_codes, self.sample, self.rounds, self.seed = cells, subvectors, codes, sample, rounds, seed

    def build(self, vectors: DataFrame, key: str = "vec_id", column: str = "embedding", path: str | None = None) -> IVFPQ:
        """The codes are written to a folder (one in the shared folder without a path), in folders by cell; searches read only those that they probe."""
        if not vectors.where(F.col(column).isNull()).isEmpty():
            raise ValueError("the column still has nulls")
        self.key, self.column = key, column
        self.vectors = ready(vectors).select(F.col(key).cast("long").alias(key), column)
        n, order = self.vectors.count(), F.xxhash64(F.lit(self.seed), key)
        if not n:
            raise ValueError("there are no vectors")
        fit = self.vectors if self.sample is None else self.vectors.where(files.under(order, n, self.sample))
        spark, folder = vectors.sparkSession, work_folder(vectors.sparkSession, "ivf")
        fit.withColumn("o", order).write.parquet(f"{folder}/fit")
        fit = spark.read.parquet(f"{folder}/fit")
        m = fit.count()
        # eight rows of the fit a cell at least; centres and codes begin as the rows with the smallest hashes
        cells = min(self.cells, max(1, m // 8))
        first = fit.orderBy("o", key).limit(max(cells, self.n_codes)).select(column).collect()
        x = unit(np.array([r[0] for r in first], float))
        if x.shape[1] % self.subvectors:
            raise ValueError("the parts do not divide the dimensions")
        rows = fit.select(column)
        self.centres = x[:cells].copy()
        for _ in range(self.rounds):
            now = self.centres
            self.centres = _means(rows, lambda v, now=now: (nearest_centre(v, now), v), now)
        centres, parts = self.centres, self.subvectors
        rest = x - centres[nearest_centre(x, centres)]
        # codes of all parts side by side: part p has the rows from p x codes on
        books = np.concatenate(np.split(rest[: self.n_codes], parts, axis=1))
        codes = len(books) // parts
        for _ in range(self.rounds):
            now = books

            def assign(v, now=now):
                off = np.split(v - centres[nearest_centre(v, centres)], parts, axis=1)
                of = [nearest_centre(o, now[p * codes : (p + 1) * codes]) + p * codes for p, o in enumerate(off)]
                return np.concatenate(of), np.concatenate(off)

            books = _means(rows, assign, now)
        self.books = np.split(books, parts)
        made = self.vectors.mapInArrow(self._encode(), f"{key} long, cell int, code binary")
        path = path or f"{folder}/codes"
        made.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        self.codes = spark.read.schema(f"{key} long, code binary, cell int").parquet(path).select(key, "cell", "code")
        return self

    def _encode(self):
        centres, books, key = self.centres, self.books, self.key

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                x = unit(matrix(b.column(1)))
                cell = nearest_centre(x, centres)
                parts = np.split(x - centres[cell], len(books), axis=1)
                code = np.stack([nearest_centre(p, c) for p, c in zip(parts, books, strict=True)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=[key, "cell", "code"])

        return run

    def _asked(self, queries: DataFrame, nprobes: int) -> dict[int, list[str]]:
        """cell -> files of the queries that look into it, at most QUERIES a file. Only the files' names come to the driver."""
        centres, folder = self.centres, work_folder(queries.sparkSession, "probes")

        def probe(batches):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                q = unit(matrix(b.column(1)))
                near = np.argsort(-(q @ centres.T - (centres**2).sum(axis=1) / 2), axis=1, kind="stable")[:, :nprobes]
                m = near.shape[1]
                ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), m)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.ravel().astype(np.int32)), pa.array([v.tobytes() for v in np.repeat(q, m, axis=0)], pa.binary())], names=["query_id", "cell", "q"])

        def store(batches):
            import uuid

            import pyarrow as pa

            cell, ids, held = None, [], []

            def flush():
                path = f"{folder}/{uuid.uuid4().hex}.npz"
                files.put_arrays(path, ids=np.array(ids, np.int64), q=np.frombuffer(b"".join(held)).reshape(len(ids), -1))
                return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([path])], names=["cell", "path"])

            for b in batches:
                for i, c, v in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if ids and (c != cell or len(ids) == QUERIES):
                        yield flush()
                        ids, held = [], []
                    cell = c
                    ids.append(i)
                    held.append(v)
            if ids:
                yield flush()

        rows = ready(queries).where("query is not null").select(F.col("query_id").cast("long").alias("query_id"), "query")
        pairs = rows.mapInArrow(probe, "query_id long, cell int, q binary")
        dealt = pairs.repartition("cell", F.pmod(F.xxhash64("query_id"), F.lit(8))).sortWithinPartitions("cell")
        out: dict[int, list[str]] = {}
        for r in dealt.mapInArrow(store, "cell int, path string").collect():
            out.setdefault(r.cell, []).append(r.path)
        return out

    def _candidates(self, asked: dict[int, list[str]], k: int) -> DataFrame:
        """query_id, key, about: the k best rows of each query, cell and task."""
        key, centres, books = self.key, self.centres, self.books

        def ranked(cell: int, rows: np.ndarray, code: np.ndarray):
            import pyarrow as pa

            for path in asked.get(cell, ()):
                got = files.get_arrays(path)
                ids, q = got["ids"], got["q"]
                tables = [(part @ book.T).astype(np.float32) for part, book in zip(np.split(q, len(books), axis=1), books, strict=True)]
                best, near = None, q @ centres[cell]
                step = max(1, (1 << 22) // len(ids))
                for a in range(0, len(rows), step):
                    d = 1 - np.repeat(near[None, :], len(rows[a : a + step]), axis=0)
                    for table, part in zip(tables, code[a : a + step].T, strict=True):
                        d -= table[:, part].T
                    j, i = nearest_of(d, rows[a : a + step], k)
                    new = (j, rows[a : a + step][i], d[i, j])
                    best = new if best is None else keep_best([best, new], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", key, "about"])

        def run(batches):
            cell, rows, codes, n = None, [], [], 0
            for b in batches:
                of = b.column(1).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                    if e == a:
                        continue
                    if n and (of[a] != cell or n >= STRETCH):
                        yield from ranked(cell, np.concatenate(rows), np.concatenate(codes))
                        rows, codes, n = [], [], 0
                    cell = int(of[a])
                    part = b.slice(a, e - a)
                    rows.append(part.column(0).to_numpy(zero_copy_only=False))
                    codes.append(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, len(books)))
                    n += e - a
            if n:
                yield from ranked(cell, np.concatenate(rows), np.concatenate(codes))

        codes = self.codes if len(asked) == len(centres) else self.codes.where(F.col("cell").isin(sorted(asked)))
        return codes.mapInArrow(run, f"query_id long, {key} long, about double")

    def search(self, queries: DataFrame, k: int, nprobes: int = 20, refine: int = 3) -> DataFrame:
        """query_id, key, _distance, rank: about the k nearest rows of each query (query_id, query). No query: no rows."""
        key, spark = self.key, queries.sparkSession
        asked = self._asked(queries, nprobes)
        best = ranked_nearest(self._candidates(asked, k * refine), k * refine, key, "about").select("query_id", key)
        folder = work_folder(spark, "candidates")
        best.write.parquet(folder)
        best = spark.read.schema(f"query_id long, {key} long").parquet(folder)
        few = F.broadcast if best.count() <= FEW else lambda side: side
        wanted = queries.select(F.col("query_id").cast("long").alias("query_id"), "query")
        exact = self.vectors.join(few(best), key).join(wanted, "query_id")
        exact = exact.select("query_id", key, (F.round(cosine_distance(F.col(self.column), F.col("query")), 5) + 0.0).alias("_distance"))
        return ranked_nearest(exact, k, key)
