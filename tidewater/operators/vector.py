"""Vector search: exact cosine neighbours, truncation, and an inverted-file index with cell pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double; null where a norm is zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, 1 - _dot(a, b) / norm)


def knn(vectors: DataFrame, query: list[float] | None, k: int, keys: list[str], column: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest rows with `_distance`; `where` applies after ranking. No query: no rows."""
    if query is None:
        return vectors.limit(0).withColumn("_distance", F.lit(None).cast("double"))
    q = F.array(*(F.lit(float(x)) for x in query))
    best = vectors.where(F.col(column).isNotNull()).withColumn("_distance", F.round(cosine_distance(F.col(column), q), 5) + 0.0)
    best = best.orderBy(F.asc_nulls_last("_distance"), *keys).limit(k)
    return best if where is None else best.where(where)


#: Queries that one scan serves on average.
QUERIES = 1024


def unit(x):
    """Rows scaled to length one; zero rows stay."""
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def stored_blocks(queries: DataFrame, size: int = QUERIES) -> list[str]:
    """The queries (query_id, query) as unit vectors in files of at most `size` in the shared folder, written by tasks: only the files' names come to the driver."""
    from tidewater.operators.maintain import work_folder
    from tidewater.session import ready
    from tidewater.sources import files

    folder = work_folder(queries.sparkSession, "queries")

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa

        ids, q = np.empty(0, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            more = unit(matrix(b.column(1)))
            ids, q = np.concatenate([ids, b.column(0).to_numpy(zero_copy_only=False)]), more if q is None else np.concatenate([q, more])
            while len(ids) >= size:
                files.put_arrays(path := f"{folder}/{uuid.uuid4().hex}.npz", ids=ids[:size], q=q[:size])
                ids, q = ids[size:], q[size:]
                yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])
        if len(ids):
            files.put_arrays(path := f"{folder}/{uuid.uuid4().hex}.npz", ids=ids, q=q)
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    rows = ready(queries).where("query is not null").select(F.col("query_id").cast("long").alias("query_id"), "query")
    dealt = rows.repartition(max(1, -(-rows.count() // size)), "query_id")
    return sorted(r.path for r in dealt.mapInArrow(run, "path string").collect())


def each_block(paths: list[str]):
    """(ids, unit vectors) of each stored block; a single one is read once a task."""
    from tidewater.sources import files

    kept: dict = {}

    def blocks():
        for path in paths:
            got = kept.get(path) or files.get_arrays(path)
            if len(paths) == 1:
                kept[path] = got
            yield got["ids"], got["q"]

    return blocks


def nearest_of(d, key, k: int):
    """(query index, row index) of the k smallest distances of each query (a column of d), ties by key."""
    import numpy as np

    n = len(d)
    if not d.size:
        return np.empty(0, int), np.empty(0, int)
    edge = np.partition(d, min(k, n) - 1, axis=0)[min(k, n) - 1]
    q, i = np.nonzero((d <= edge).T)
    order = np.lexsort((key[i], d[i, q], q))
    q, i = q[order], i[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], i[place < k]


def ranked_nearest(part: DataFrame, k: int, key: str, distance: str = "_distance") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(distance, key)
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def matrix(column):
    """The rows of a list column without nulls, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


#: Bytes of vectors that a task holds while it reads the blocks of queries; rows that are compared at a time.
HELD, ROWS = 1 << 28, 8192


def held(batches, limit: int = HELD):
    """Lists of (keys, rows of vectors) of Arrow batches (key, list of numbers), each list of about `limit` bytes."""
    out, size = [], 0
    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            part = b.slice(a, ROWS)
            keys, flat = part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy(zero_copy_only=False)
            out.append((keys, flat.reshape(len(keys), -1)))
            size += flat.nbytes + keys.nbytes
            if size >= limit:
                yield out
                out, size = [], 0
    if out:
        yield out


def keep_best(parts: list, k: int):
    """(query, key, distance) arrays with the k nearest of each query, from several such triples."""
    import numpy as np

    q, key, d = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((key, d, q))
    q, key, d = q[order], key[order], d[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], key[place < k], d[place < k]


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, key, _distance, rank: the k nearest rows of each query (query_id, query), exactly. Integer keys.

    A task holds its vectors (HELD bytes at a time) and reads the blocks of queries once for them; it keeps the k best of each
    query as it goes, so that the shuffle gets k rows a query and task. No query: no rows."""
    from tidewater.session import ready

    rows = ready(vectors).where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), column)
    blocks = each_block(stored_blocks(queries))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for chunks in held(batches):
            for ids, q in blocks():
                best = None
                for keys, x in chunks:
                    d = np.round(1 - unit(x.astype(float)) @ q.T, 5) + 0.0
                    j, i = nearest_of(d, keys, k)
                    new = (j, keys[i], d[i, j])
                    best = new if best is None else keep_best([best, new], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", key, "_distance"])

    return ranked_nearest(rows.mapInArrow(run, f"query_id long, {key} long, _distance double"), k, key)


def truncate(vector: Column, dims: int) -> Column:
    """The first dims values, scaled to length one (a zero vector stays); shorter vectors are an error."""
    v = F.transform(F.slice(vector, 1, dims), lambda x: x.cast("double"))
    norm = F.sqrt(_dot(v, v))
    out = F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(F.lit(1.0)))
    return F.when(F.size(vector) >= dims, out).otherwise(F.raise_error(F.lit("the vector has too few dimensions")).cast("array<double>"))


class IVF:
    """Cells around k-means centres; a query looks into the `nprobes` nearest cells and ranks their vectors exactly."""

    def __init__(self, cells: int = 16, seed: int = 42, rounds: int = 10):
        self.cells, self.seed, self.rounds, self.centres, self.data = cells, seed, rounds, [], None

    def build(self, vectors: DataFrame, column: str = "embedding") -> IVF:
        """Null vectors are an error: they would never be found."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if vectors.where(F.col(column).isNull()).limit(1).count():
            raise ValueError("the column still has nulls")
        unit = vectors.withColumn("__v", array_to_vector(truncate(F.col(column), len(vectors.select(column).first()[0]))))
        model = KMeans(k=self.cells, seed=self.seed, maxIter=self.rounds, featuresCol="__v", predictionCol="cell").fit(unit)
        self.centres = [list(map(float, c)) for c in model.clusterCenters()]
        self.data = model.transform(unit).drop("__v")
        return self

    def search(self, query: list[float], k: int, keys: list[str], nprobes: int = 8, column: str = "embedding") -> DataFrame:
        norm = sum(x * x for x in query) ** 0.5 or 1.0
        near = sorted(range(len(self.centres)), key=lambda c: sum((a - b / norm) ** 2 for a, b in zip(self.centres[c], query, strict=True)))[:nprobes]
        return knn(self.data.where(F.col("cell").isin(near)), query, k, keys, column)
