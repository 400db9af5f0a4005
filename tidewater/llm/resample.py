"""Importance resampling: draw the documents whose runs of words are most like those of a target collection.

Features are all runs of 1 to 3 consecutive words, hashed into BUCKETS buckets. Two scans of the texts: one counts buckets
(a dense array a task, summed by bucket), one adds up each document's gains, which stand in an array by bucket. A draw with
keyed noise (the Gumbel top-k trick) takes the best `percent` of the documents that are long enough.

The draw is an external merge sort that stops early. Eligible rows are sorted within their partitions into run files in the
shared folder. Bounds from a bounded sample cut the order into ranges; run files note where each range begins, so the ranges'
sizes are exact, and so are the first rank of each range and the range in which the draw ends. Each range that holds drawn
rows is merged by itself from its slices of all runs, by a tournament tree (of at most FAN slices at a time; more are merged
in levels), and stops after its share of the exact draw count. Ranges below the cut are never read. No task holds more than a
range's open blocks, and the sample decides only how even the ranges are.

Defined results: null and empty texts have no words, weight 0 and no rank; a null id is hashed as the empty string and comes
last among ties; repeated rows are drawn each (ties in score and id in any order); ids are integers. An empty target gives
each bucket the gain of an empty count. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernel
from tidewater.llm.common import filesystem, materialise, numbered, within, work_dir
from tidewater.session import ready

BUCKETS = 10_000
#: Words of a run at most.
GRAM = 3
#: Rows that a range should hold, and ranges of drawn rows at most.
RANGE_ROWS, RANGES = 1024, 400
#: Rows whose keys are sampled for bounds, at most.
SAMPLE = 131_072
#: Slices that one tournament merges, and rows that a slice keeps in memory.
FAN, BLOCK = 128, 4096
#: Words whose features are hashed at a time.
WORDS = 1 << 18

WORD = kernel.table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
ROW = np.dtype([(c, "<i8") for c in ("below", "none", "id", "rid", "n_features", "weight")])
KEY = ("below", "none", "id", "rid")
SCORED = "rid long, id long, n_words long, n_features long, weight long, score long"

# --- checksums of many byte ranges at once


def _crc_table() -> np.ndarray:
    """The 256 remainders of the reflected CRC-32 polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


CRC = _crc_table()
#: Lengths whose shift has a table of its own.
SHORT = 64


def _shifts() -> np.ndarray:
    """[n, j, v]: what the byte v in place j of a checksum becomes when n zero bytes follow."""
    step = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    out = [step]
    for _ in range(SHORT):
        step = CRC[step & 255] ^ (step >> np.uint32(8))
        out.append(step)
    return np.stack(out)


SHIFT = _shifts()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums of data that go on with n more bytes, to be xor-ed with the checksums of those bytes."""
    n = np.array(n)
    while True:
        part = np.minimum(n, SHORT)
        crc = SHIFT[part, 0, crc & 255] ^ SHIFT[part, 1, (crc >> 8) & 255] ^ SHIFT[part, 2, (crc >> 16) & 255] ^ SHIFT[part, 3, crc >> 24]
        n = n - part
        if not n.any():
            return crc


def word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges: short ones byte by byte side by side, long ones each by itself."""
    out = np.empty(len(start), np.uint32)
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    n, at = size[order], start[order]
    long = int(np.count_nonzero(size > SHORT))
    for k in range(long):
        out[order[k]] = zlib.crc32(data[at[k] : at[k] + n[k]])
    order, n, at = order[long:], n[long:], at[long:]
    c = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for k in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -k, side="left"))  # words longer than k
        c[:m] = CRC[(c[:m] ^ data[at[:m] + k]) & 255] ^ (c[:m] >> np.uint32(8))
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


SPACE = np.uint32(zlib.crc32(b" "))


def features(column, buckets: int = BUCKETS):
    """((row of each feature, bucket of each feature) in pieces, words a row) of an Arrow column of texts."""
    data, offsets = kernel.column_bytes(column)
    data = kernel.LOWER[data]
    runs = kernel.Runs(data, offsets, WORD[data])

    def pieces():
        for a in range(0, len(runs.start), WORDS):
            lo, hi = max(0, a - GRAM + 1), min(len(runs.start), a + WORDS)
            row, size = runs.row[lo:hi], runs.end[lo:hi] - runs.start[lo:hi]
            word = word_crcs(data, runs.start[lo:hi], size)
            spaced = shifted(np.full(len(word), SPACE), size) ^ word
            gram, keep = word, np.arange(hi - lo) >= a - lo
            yield row[keep], gram[keep] % buckets
            for k in range(1, GRAM):  # runs of k + 1 words, by their last word
                gram = shifted(gram[:-1], size[k:] + 1) ^ spaced[k:]
                own = (row[k:] == row[:-k]) & keep[k:]
                yield row[k:][own], gram[own] % buckets

    return pieces(), np.diff(runs.of)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: one array a task, summed by Spark; the sums are at most `buckets` rows."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in within(batch, column=0):
                for _, b in features(part.column(0), buckets)[0]:
                    total += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = ready(docs).select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, rounded down."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    pair = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in pair], np.int64)


def noise(id, seed: int) -> int:
    """Keyed noise of an id: thousandths of a Gumbel variate, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, id: str, text: str, seed: int, rid: str | None = None) -> DataFrame:
    """rid, id, n_words, n_features, weight, score of each row, stored. rid: the column with each row's own number; None: one is made."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in within(batch, column=2):
                pieces, n_words = features(part.column(2), len(gain))
                n, weight = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for row, b in pieces:
                    n += np.bincount(row, minlength=part.num_rows)
                    weight += np.bincount(row, gain[b], minlength=part.num_rows).astype(np.int64)
                score = [w + noise(i, seed) for w, i in zip(weight.tolist(), part.column(1).to_pylist(), strict=True)]
                cols = [part.column(0), part.column(1), *map(pa.array, (n_words.astype(np.int64), n, weight)), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["rid", "id", "n_words", "n_features", "weight", "score"])

    number = F.col(rid) if rid else F.monotonically_increasing_id()
    rows = ready(docs).select(number.alias("rid"), F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, SCORED), "scores")


# --- sorted runs and their merge


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key's columns in ascending order: best score first, then id (null last), then row."""
    return rows.select((-F.col("score")).alias("below"), F.col("id").isNull().cast("long").alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "rid", "n_features", "weight")


def bounds_of(rows: DataFrame, n: int, draw: int) -> list[tuple]:
    """Keys that cut the drawn part of the order, and a margin below it, into ranges of about equal size."""
    wanted = max(1, min(RANGES, -(-draw // RANGE_ROWS)))
    size = min(SAMPLE, 16 * wanted * -(-n // draw))
    few = F.lit(True) if size >= n else F.xxhash64("rid") < F.lit(int(-(1 << 63) + (1 << 64) * size / n))
    keys = sorted(tuple(r) for r in rows.where(few).select(*KEY).orderBy(F.xxhash64("rid")).limit(2 * SAMPLE).collect())
    drawn = len(keys) * draw / n
    step, last = drawn / wanted, min(len(keys) - 1, drawn * 1.25 + 4 * math.sqrt(drawn) + 4)
    at = sorted({int(step * j) for j in range(1, int(last / step) + 1 if step else 1)} - {0})
    return [keys[i] for i in at if i < len(keys)]


def write_runs(rows: DataFrame, bounds: list[tuple], folder: str) -> DataFrame:
    """range, path, start, n: the rows of each partition as a sorted file of fixed-size records, and where its ranges lie. Stored."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = filesystem(f"{folder}/run-{task.partitionId():06d}-{task.taskAttemptId()}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        cuts, total = [0], 0
        with system.open_output_stream(path, compression=None) as out:
            for batch in batches:
                block = np.empty(batch.num_rows, ROW)
                for c, name in zip(batch.columns, ROW.names, strict=True):
                    block[name] = c.to_numpy(zero_copy_only=False)
                while len(cuts) <= len(bounds) and len(block) and block[-1].item()[: len(KEY)] >= bounds[len(cuts) - 1]:
                    lo, hi = 0, len(block)
                    while lo < hi:  # the first row that the bound does not exceed
                        mid = (lo + hi) // 2
                        lo, hi = (lo, mid) if block[mid].item()[: len(KEY)] >= bounds[len(cuts) - 1] else (mid + 1, hi)
                    cuts.append(total + lo)
                out.write(block.tobytes())
                total += len(block)
        ends = [*cuts[1:], total]
        found = [(r, a, b - a) for r, (a, b) in enumerate(zip(cuts, ends, strict=True)) if b > a]
        cols = [pa.array([f[0] for f in found], pa.int32()), pa.array([f"{folder}/{path.rpartition('/')[2]}"] * len(found), pa.string())]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array([f[i] for f in found], pa.int64()) for i in (1, 2))], names=["range", "path", "start", "n"])

    ordered = ready(rows).sortWithinPartitions(*KEY)
    return materialise(ordered.mapInArrow(run, "range int, path string, start long, n long"), "runs")


def records(path: str, start: int, n: int):
    """The rows of a slice of a run, a block in memory at a time."""
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        for a in range(start, start + n, BLOCK):
            m = min(BLOCK, start + n - a)
            yield from np.frombuffer(f.read_at(m * ROW.itemsize, a * ROW.itemsize), ROW).tolist()


def tournament(sources: list):
    """All rows of sorted iterators in order. Each inner node of the tree keeps the loser of its match, so a row costs one path."""
    n = len(sources)
    head = [next(s, None) for s in sources]
    beats = lambda a, b: head[a] is not None and (head[b] is None or head[a] < head[b])
    winner, loser = [0] * n + list(range(n)), [0] * n
    for j in range(n - 1, 0, -1):
        a, b = winner[2 * j], winner[2 * j + 1]
        winner[j], loser[j] = (b, a) if beats(b, a) else (a, b)
    best = winner[1] if n > 1 else 0
    while n and head[best] is not None:
        yield head[best]
        head[best] = next(sources[best], None)
        j = (best + n) // 2
        while j:
            if beats(loser[j], best):
                best, loser[j] = loser[j], best
            j //= 2


def merged(slices: list[tuple], folder: str, name: str):
    """The rows of slices (path, start, n) in order; more than FAN slices are first merged into fewer, in files."""
    level = 0
    while len(slices) > FAN:
        out = []
        for k in range(0, len(slices), FAN):
            system, path = filesystem(target := f"{folder}/{name}-{level}-{k // FAN}")
            total, block = 0, []
            with system.open_output_stream(path, compression=None) as f:
                for row in tournament([records(*s) for s in slices[k : k + FAN]]):
                    block.append(row)
                    if len(block) == BLOCK:
                        f.write(np.array(block, ROW).tobytes())
                        total, block = total + len(block), []
                f.write(np.array(block, ROW).tobytes())
                total += len(block)
            out.append((target, 0, total))
        slices, level = out, level + 1
    return tournament([records(*s) for s in slices])


DRAWN = "below long, none long, id long, rid long, n_features long, weight long, rank long"


def merge_ranges(index: DataFrame, quota: dict[int, tuple[int, int]], folder: str) -> DataFrame:
    """The first rows of each range, ranked. quota: range -> (rank before it, rows to take)."""

    def run(batches):
        import pyarrow as pa
        from itertools import groupby, islice

        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        rows = ((r, s) for b in batches for r, *s in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for r, group in groupby(rows, key=lambda x: x[0]):
            rank, most = quota[r]
            best = islice(merged([tuple(s) for _, s in group], folder, f"level-{r}-{attempt}"), most)
            while block := list(islice(best, BLOCK)):
                cols = [pa.array(c, pa.int64()) for c in zip(*block, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(range(rank + 1, rank + 1 + len(block)), pa.int64())], names=[*ROW.names, "rank"])
                rank += len(block)

    wanted = index.where(F.col("range") <= max(quota)).repartition("range").sortWithinPartitions("range", "path")
    return materialise(wanted.mapInArrow(run, DRAWN), "drawn")


def after(key: tuple) -> Column:
    """Rows of `_keyed` that come after a key."""
    out = F.lit(False)
    for c, v in zip(reversed(KEY), reversed(key), strict=True):
        out = (F.col(c) > v) | ((F.col(c) == v) & out)
    return out


def top(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """_keyed rows with rank: 1, 2, 3 ... for the best `percent` of 100 of the eligible rows, null for all others."""
    good = F.coalesce(eligible, F.lit(False))
    n = scored.where(good).count()
    draw = percent * n // 100
    unranked = lambda rows: _keyed(rows).withColumn("rank", F.lit(None).cast("long"))
    if not draw:
        return unranked(scored)
    rows, folder = _keyed(scored.where(good)), work_dir(scored.sparkSession, "merge")
    index = write_runs(rows, bounds_of(rows, n, draw), folder)
    sizes = sorted((r["range"], r["sum(n)"]) for r in index.groupBy("range").sum("n").collect())  # a row a range
    quota, rank = {}, 0
    for r, size in sizes:
        if rank < draw:
            quota[r] = (rank, min(size, draw - rank))
            rank += quota[r][1]
    drawn = merge_ranges(index, quota, folder)
    last = drawn.where(F.col("rank") == draw).select(*KEY).first()
    return drawn.unionByName(unranked(scored.where(~good))).unionByName(unranked(scored.where(good)).where(after(tuple(last))))


def _best(docs: DataFrame, target: DataFrame, percent: int, least: int, seed: int, id: str, text: str, buckets: int, rid: str | None = None) -> DataFrame:
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    return top(scores(docs, gain, id, text, seed, rid), F.col("n_words") >= least, percent)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row a document; rank is null for those that are not drawn.

    percent: of 100 documents with at least `least` words, how many are drawn. The target's texts stand in a column of the same name."""
    out = _best(docs, target, percent, least, seed, id, text, buckets)
    return out.select(F.when(F.col("none") == 0, F.col("id")).alias("doc_id"), "n_features", "weight", (-F.col("below")).alias("score"), "rank")


def drawn_rows(
    docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """The drawn rows of docs themselves, with all their columns, whatever their names."""
    stored, rid = numbered(docs, "resample")
    best = _best(stored, target, percent, least, seed, id, text, buckets, rid).where("rank is not null").select(F.col("rid").alias(rid))
    return stored.join(best, rid, "left_semi").drop(rid)
