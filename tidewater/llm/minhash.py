"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct windows of five words (A-Z lower-cased; fewer words: the whole sequence as one window; no
word: empty, linked with nothing). Equal sets are one class. Classes that share a band of their MinHash signature meet in
that band's bucket. Signature batches are compared one after another; a pair is dropped as soon as the posterior probability
that its similarity reaches the threshold falls under `miss`. Survivors are verified exactly on their full sets unless
verified links already join them. Components of the verified links are found by alternating star contractions.

Bands are worked in rounds: once the first bands have joined most copies, a bucket of later bands is worked only if it holds
members of different components, and buckets with the same members once. So a group of near copies is sent about once.

A large bucket is first worked block by block, each block with the same few members of the bucket besides (HUBS), which
joins most of a group of near copies in linear work. After the rounds the members outside the bucket's largest component, in
blocks, meet all its members, so that no pair of different components is left out: first by signatures alone; then those that
have a partner left are sent again with their sets.

Defined results: a null text is an empty text; documents without words have n_shingles 0 and are their own component;
repeated rows and equal doc_ids are handled row by row (a class is a set, not an id); null doc_ids never name a component
unless all its documents have none. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import kernel
from tidewater.llm.common import discard, lean, materialise, numbered, within
from tidewater.session import ready

ROWS, BATCH = 4, 25
#: A pair at the threshold shares no band with this probability at most.
UNMET = 4.5e-7
K = 250
WORDS = 5
#: Block bounds: classes, and shingles, that one side of a block pair holds on average.
BLOCK, BLOCK_SHINGLES = 192, 1 << 20
#: A block of members outside the largest component, and of those that they meet, is so many times as large: members move less.
WIDE = 4
#: Members of a large bucket that all its members are compared with first.
HUBS = 4
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)


def shingle_sets(batch, column: int = 1) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow batch."""
    data, offsets = kernel.column_bytes(batch.column(column))
    data = kernel.LOWER[data]
    words = kernel.Runs(data, offsets, ~kernel.SPACE[data])
    shingle, at = kernel.windows(kernel.Hasher(data)(words.start, words.end), words.of, WORDS, short=True)
    row = words.row[at]
    if len(row) and (np.diff(row) < 0).any():
        order = np.argsort(row, kind="stable")
        shingle, row = shingle[order], row[order]
    return kernel.row_sets(shingle, np.searchsorted(row, np.arange(batch.num_rows + 1)))


def signatures(sets: list[np.ndarray], k: int = K) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets, one row each."""
    out = np.empty((len(sets), k), np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    work = np.empty_like(flat)
    for i in range(k):
        np.multiply(flat, _A[i], out=work)
        np.add(work, _B[i], out=work)
        out[:, i] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


def bands_of(percent: int) -> int:
    """The bands that a threshold needs."""
    n = math.ceil(math.log(UNMET) / math.log1p(-((percent / 100) ** ROWS))) if percent < 100 else 1
    if n * ROWS > K:
        raise ValueError(f"{K} hashes are too few for a threshold of {percent} %")
    return n


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    key = np.zeros((len(sig), bands), np.uint64)
    for r in range(ROWS):
        key = kernel.mix(key + sig[:, r : ROWS * bands : ROWS].astype(np.uint64) + np.uint64(1))
    return kernel.mix(key + np.arange(bands, dtype=np.uint64)).view(np.int64)


def node_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketch(bands: int):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in within(whole):
                sets = shingle_sets(batch)
                full = [s for s in sets if len(s)]
                keys = band_keys(signatures(full, ROWS * bands), bands)
                has = np.array([len(s) > 0 for s in sets])
                offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([node_of(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "node", "n_shingles", "bands"],
                )

    return run


def _sets(batches):
    """(id, text, node) -> (node, set, signature) of the rows whose text has that node."""
    import pyarrow as pa

    for whole in batches:
        for batch in within(whole):
            wanted = batch.column(2).to_pylist()
            pick = [(n, s) for n, s in zip(wanted, shingle_sets(batch), strict=True) if len(s) and node_of(s) == n]
            sig = signatures([s for _, s in pick])
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in pick], pa.binary()), pa.array([s.tobytes() for _, s in pick], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["node", "shingles", "sig"],
            )


def least_matches(threshold: float, miss: float, k: int = K, batch: int = BATCH) -> list[int]:
    """For each number of compared hashes, the fewest matches at which P(similarity >= threshold) is still at least `miss`.

    Uniform prior: after m matches of n the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is
    P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(batch, k + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log(1 - threshold))
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact verification of two sets."""
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(both) - inter)


def survivors(sigs, side, label, band: int, least: list[int], sizes=None, percent: int = 0):
    """(i, partners j > i, their matching hashes) of each member with partners of other components that the posterior does not rule out."""
    n = len(sigs)
    keys = band_keys(sigs, band) if band else None
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[label[j] != label[i]]
        if side is not None:
            j = j[side[j] != side[i]]
        if sizes is not None:
            j = j[(100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i]))]
        if band and len(j):  # a pair is worked in the first band that it shares
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
        match = np.zeros(len(j), np.int64)
        for b, need in enumerate(least):
            if not len(j):
                break
            match += (sigs[j, b * BATCH : (b + 1) * BATCH] == sigs[i, b * BATCH : (b + 1) * BATCH]).sum(axis=1)
            ok = match >= need
            j, match = j[ok], match[ok]
        if len(j):
            yield i, j, match


def block_links(sets, sigs, side, band: int, percent: int, least: list[int], label: np.ndarray | None = None):
    """Index pairs of verified links of a block (side None: all pairs; else pairs across sides), as far as they join new classes.

    label: components that are known, whose inner pairs are left out."""
    n, out = len(sets), []
    if label is None:
        label = np.arange(n)
    _, first, kind = np.unique(label, return_index=True, return_inverse=True)
    parent = first[kind].tolist()
    sizes = np.array([len(s) for s in sets])
    found = [(np.full(len(j), i), j, match) for i, j, match in survivors(sigs, side, label, band, least, sizes, percent)]
    if not found:
        return out
    left, right, match = (np.concatenate(x) for x in zip(*found, strict=True))
    for e in np.argsort(-match, kind="stable").tolist():
        i, j = int(left[e]), int(right[e])
        a, b = _find(parent, i), _find(parent, j)
        if a == b:
            continue
        if similar(sets[i], sets[j], percent):
            parent[a] = b
            out.append((i, j))
    return out


def _units(batches, width: int, work):
    """work(rows, head) of each run of rows with equal first four columns, whose other columns (`width` of them) are its rows."""
    rows, unit = [], None
    for batch in batches:
        heads = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        own = [batch.column(i) for i in range(4, 4 + width)]
        for r, head in enumerate(heads):
            if head != unit:
                if len(rows) > 1:
                    yield from work(rows, unit)
                rows, unit = [], head
            rows.append(tuple(c[r].as_py() for c in own))
    if len(rows) > 1:
        yield from work(rows, unit)


def _once(rows):
    """The rows by node, each node once (a hub stands in a block of its own as well), in ascending order."""
    own: dict[bytes, tuple] = {}
    for node, *rest in rows:
        own.setdefault(node, rest)
    return sorted(own.items())


def _out(made, kinds, names, size: int = 5000):
    """Batches of tuples."""
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=names)
    rows = []
    for x in made:
        rows.append(x)
        if len(rows) >= size:
            yield batch(rows)
            rows = []
    yield batch(rows)


def _links(percent: int, miss: float):
    """Rows (unit, node, block, set, signature, label) -> verified links."""
    least = least_matches(percent / 100, miss)

    def work(rows, unit):
        nodes, rest = zip(*_once(rows), strict=True)
        sets = [np.frombuffer(x[1], np.uint64) for x in rest]
        sigs = np.array([np.frombuffer(x[2], np.uint32) for x in rest])
        side = None if unit[2] == unit[3] else np.array([x[0] for x in rest])
        label = np.unique([x[3] for x in rest], return_inverse=True)[1]
        for i, j in block_links(sets, sigs, side, unit[0], percent, least, label):
            yield nodes[i], nodes[j]

    def run(batches):
        import pyarrow as pa

        yield from _out(_units(batches, 5, work), [pa.binary()] * 2, ["u", "v"])

    return run


def _survivors(percent: int, miss: float):
    """Rows (unit, node, block, signature, label) -> the same without signatures, as far as they have a partner left."""
    least = least_matches(percent / 100, miss)

    def work(rows, unit):
        nodes, rest = zip(*_once(rows), strict=True)
        sigs = np.array([np.frombuffer(x[1], np.uint32) for x in rest])
        side = None if unit[2] == unit[3] else np.array([x[0] for x in rest])
        label = np.unique([x[2] for x in rest], return_inverse=True)[1]
        alive = np.zeros(len(nodes), bool)
        for i, j, _ in survivors(sigs, side, label, unit[0], least):
            alive[i] = True
            alive[j] = True
        for i in np.flatnonzero(alive).tolist():
            yield (*unit, nodes[i], rest[i][0], rest[i][2])

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
        yield from _out(_units(batches, 4, work), kinds, ["band", "key", "lo", "hi", "node", "blk", "label"])

    return run


def _among(n) -> Column:
    """The block of a node, of n."""
    return F.pmod(F.xxhash64("node", F.lit(3)), F.col(n).cast("long")).cast("int")


def deal_blocks(members: DataFrame) -> DataFrame:
    """band, key, lo, hi, node, blk, label: each bucket's members by block, and its hubs in every block of large buckets."""
    own = members.select("band", "key", "node", _among("blocks").alias("blk"), "label")
    some = [F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(100 + i))) for i in range(HUBS)]
    hubs = members.where("blocks > 1").groupBy("band", "key").agg(F.array_distinct(F.array(*some)).alias("hubs"), F.max("blocks").alias("blocks"))
    hubs = hubs.select("band", "key", "blocks", F.explode("hubs").alias("hub"))
    hubs = hubs.select("band", "key", "hub.node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), "hub.label")
    return own.unionAll(hubs).select("band", "key", F.col("blk").alias("lo"), F.col("blk").alias("hi"), "node", "blk", "label")


def _blocks(n, s):
    return F.greatest(F.ceil(n / (WIDE * BLOCK)), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")


def deal(large: DataFrame) -> DataFrame:
    """band, key, lo, hi, node, blk, label: the members of each pair of blocks of a bucket in which components can meet."""
    per = large.groupBy("band", "key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    whole = per.groupBy("band", "key").agg(F.max(F.struct("n", "label", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = whole.where("n > top.n").select(
        "band", "key", F.col("top.label").alias("top"), _blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("outer"), _blocks(F.col("top.n"), F.col("top.s")).alias("inner")
    )
    own = large.join(materialise(whole, "buckets"), ["band", "key"]).withColumn("in", F.col("label") == F.col("top"))
    own = own.withColumn("blk", F.when(F.col("in"), F.col("outer") + _among("inner")).otherwise(_among("outer")))
    last = F.when(F.col("in"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    own = own.select("band", "key", "node", "blk", "label", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return own.select("band", "key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "node", "blk", "label")


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, label: the smallest node of each node's component. Large-star and small-star contractions until nothing changes."""
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    state, edges = None, materialise(edges, "links")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        before, edges = edges, materialise(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct(), "links")
        discard(before)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


#: Bands after which components are found and buckets that lie within one component are done: the first ones join most copies.
ROUNDS = (2, 8)


def _buckets(part: DataFrame) -> DataFrame:
    """Buckets with members of different components: band, key, their size, and hashes of their members."""
    h = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    own = part.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), h(1).alias("h1"), h(2).alias("h2"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return own.where("lo <> hi").drop("lo", "hi")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 85, miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row a document."""
    pick = ready(docs).select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind, bands = pick.schema["doc_id"].dataType.simpleString(), bands_of(percent)
    sketch = materialise(pick.mapInArrow(lean(_sketch(bands)), f"doc_id {kind}, node binary, n_shingles long, bands array<long>"), "sketch")
    classes = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = materialise(classes, "classes")
    # a key is of one band only; counts by key alone tell the buckets with several members
    many = classes.select(F.explode("bands").alias("key")).groupBy("key").count().where("count > 1").select("key")
    members = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key")).join(many, "key")
    members = materialise(members.select("band", "key", "node", "n_shingles"), "members")
    wanted = materialise(members.select("node").distinct().join(classes.select("node", "rep"), "node"), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= 500_000 else wanted
    sets = pick.join(side, pick.doc_id.eqNullSafe(side.rep)).select("doc_id", "text", "node")
    sets = materialise(sets.mapInArrow(lean(_sets), "node binary, shingles binary, sig binary"), "sets")
    unit, spent = ["band", "key", "lo", "hi"], [members, wanted, sets]

    def worked(dealt: DataFrame, run, schema: str, *columns: str) -> DataFrame:
        rows = dealt.join(sets.select("node", *columns), "node").select(*unit, "node", "blk", *columns, "label")
        rows = rows.repartition(*unit).sortWithinPartitions(*unit)
        spent.append(materialise(rows.mapInArrow(lean(run), schema), "links"))
        return spent[-1]

    def links_of(dealt: DataFrame) -> DataFrame:
        return worked(dealt, _links(percent, miss), "u binary, v binary", "shingles", "sig")

    links, labels, seen, large = None, None, None, None
    edges = [0, *(r for r in ROUNDS if r < bands), bands]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = _labelled(members.where((F.col("band") >= lo) & (F.col("band") < hi)), labels)
        # buckets with the same members are one unit, kept under their first band
        same = ["n", "s", "h1", "h2"]
        units = _buckets(part).groupBy(*same).agg(F.min(F.struct("band", "key")).alias("first"))
        if seen is not None:
            units = units.join(seen, same, "left_anti")
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
        units = materialise(units.select(*same, "first.band", "first.key", blocks.alias("blocks")), "units")
        seen = units.select(*same) if seen is None else seen.unionAll(units.select(*same))
        work = materialise(part.join(units.select("band", "key", "blocks"), ["band", "key"]).select("band", "key", "blocks", "node", "n_shingles", "label"), "members")
        spent += [units, work]
        more = links_of(deal_blocks(work))
        links = more if links is None else links.unionAll(more)
        labels = components(links)
        rest = work.where("blocks > 1").drop("blocks", "label")
        large = rest if large is None else large.unionAll(rest)
    if not large.isEmpty():
        left = _labelled(large, labels)
        open_ = _buckets(left).select("band", "key")
        dealt = materialise(deal(left.join(open_, ["band", "key"])), "dealt")
        spent.append(dealt)
        # ids and signatures first; sets only of members that have a partner left
        alive = worked(dealt, _survivors(percent, miss), "band int, key long, lo int, hi int, node binary, blk int, label binary", "sig")
        more = links_of(alive)
        if not more.isEmpty():
            links = links.unionAll(more)
            labels = components(links)
    named = classes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    named = materialise(named.join(least, "label").select("node", "component"), "components")
    discard(*spent, classes)
    out = sketch.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, one of each component: that with the smallest id (null ids last), any one of rows that share it.

    Rows are told apart by numbers of their own, so equal ids, and equal rows, are documents each; other columns may have any names."""
    rows, rid = numbered(ready(docs), "rows")
    key = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col(rid).alias("rid"))
    gone = near_duplicates(rows.select(key.alias("doc_id"), F.col(text).alias("text")), percent=percent).where("not kept").select("doc_id.rid")
    gone = materialise(gone, "removed")
    side = F.broadcast(gone) if gone.count() <= 500_000 else gone
    return rows.join(side, rows[rid] == side["rid"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
