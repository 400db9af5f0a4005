"""The prefix trie of conversations: a node for each distinct sequence of first turns, with what it and its subtree hold.

Turns become blocks of 24 bytes (a 128-bit digest of role and text, and the text's length), a conversation becomes the string
of its blocks, so that prefixes of conversations are prefixes of strings and the order of strings is the order of a depth-first
walk. Equal conversations are one string with a count before anything is sorted. The strings are sorted in ranges, and each
range builds its part of a Patricia tree in one pass over its strings: a stack holds the open points of the current path, and
only branches, ends and leaves become points; the turns between two points are one compressed edge. Sums (conversations,
smallest id, leaves, bytes with and without repeats) are made on points alone. When a point closes, its edge is expanded into
nodes by suffix sums of the edge's bytes, as all nodes of an edge have the same members.

Nodes that two ranges share lie on the paths that the neighbours' last and first strings have in common. A range is told the
length of the common prefix on either side, so it knows which nodes it shares and which of them an earlier range has counted;
it reports partial sums for these, which one small aggregation adds up. A child whose parent is shared learns the parent's
smallest id by a join.

The lists of members that end at a node are hashed in pieces: ids are sorted in ranges by (string, id) and joined to texts of
PIECE ids; only these texts of one node meet in a task, which hashes them one after another and holds none of them. SHA-256
has no other way.

Defined results: rows without a conversation id are left out; null turns come first, turns of equal number in the order of
their digests; null roles and texts are empty; repeated rows are turns of their own; conversations without turns end at the
root. An empty table gives no node. Other columns play no part. A conversation is one row of 24 bytes a turn: the longest
must fit a task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialise
from tidewater.session import ready

#: Bytes of a turn: digest and length of its text.
DIGEST, LENGTH = 16, 8
BLOCK = DIGEST + LENGTH
#: Ids of a text that is hashed at once.
PIECE = 256
#: Shared nodes up to which they are broadcast.
FEW = 100_000
EMPTY = hashlib.sha256(b"").hexdigest()


def block(role: Column, text: Column) -> Column:
    """24 bytes that tell a turn from others; the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.left(digest, F.lit(2 * DIGEST)), F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH, "0")))


def _bytes(array: Column) -> Column:
    """An array of blocks as one string of bytes; an empty one for none."""
    return F.unhex(F.array_join(F.transform(array, F.hex), ""))


def strings(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, own (array of blocks in the order of turns): a row a conversation."""
    rows = turns.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), block(F.col(role), F.col(text)).alias("b")).alias("t"))
    # nulls are the smallest values of a sort
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t.b).alias("own"))


def rebuilt(own: DataFrame, share: int = 5, most: int = 9) -> DataFrame:
    """conv_id, key: each conversation c begins with the first h turns of c - c % share; its own go on after its first h. h = crc32(c) % most."""
    c = F.col("conv_id")
    head = (F.crc32(c.cast("string")) % most).cast("int")
    donors = own.where(c % share == 0).select(c.alias("base"), F.slice("own", 1, most - 1).alias("donor"))
    rows = own.withColumns({"base": c - c % share, "h": head}).join(donors, "base", "left")
    begin = F.when(F.col("donor").isNull(), F.array().cast("array<binary>")).otherwise(F.slice("donor", F.lit(1), F.col("h")))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", _bytes(F.concat(begin, rest)).alias("key"))


def ends(conversations: DataFrame) -> DataFrame:
    """code, ends_sha256: for each string (by digest), its conversations' ids in ascending order, joined by commas and hashed."""

    def pieces(batches):
        import pyarrow as pa

        code, held, number = None, [], 0
        for b in batches:
            out = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (k != code or len(held) == PIECE):
                    out.append((code, held[0], ",".join(map(str, held))))
                    held = []
                code = k
                held.append(c)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["code", "first", "ids"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([code], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))], pa.string())], names=["code", "first", "ids"])

    def hashed(batches):
        import pyarrow as pa

        code, state = None, None
        for b in batches:
            out = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != code:
                    if state:
                        out.append((code, state.hexdigest()))
                    code, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["code", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([code], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["code", "ends_sha256"])

    rows = ready(conversations).select("code", "conv_id").repartitionByRange("code", "conv_id").sortWithinPartitions("code", "conv_id")
    texts = rows.mapInArrow(pieces, "code binary, first long, ids string").repartition("code").sortWithinPartitions("code", "first").select("code", "ids")
    return texts.mapInArrow(hashed, "code binary, ends_sha256 string")


def common(a: bytes, b: bytes) -> int:
    """Blocks that two strings have in common at their beginning."""
    most = min(len(a), len(b)) // BLOCK
    if a[: most * BLOCK] == b[: most * BLOCK]:
        return most
    low, high = 0, most - 1  # the prefix of `low` blocks is common, that of `high` + 1 is not
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * BLOCK : mid * BLOCK] == b[low * BLOCK : mid * BLOCK] else (low, mid - 1)
    return low


class Point:
    """A branch, end or leaf of the compressed tree, while its subtree is being read. Sums leave out the point's own turn."""

    __slots__ = ("depth", "n", "least", "with_repeats", "once", "leaves", "children", "ends", "first", "waiting")

    def __init__(self, depth: int):
        self.depth, self.n, self.least, self.with_repeats, self.once = depth, 0, None, 0, 0
        self.leaves, self.children, self.ends, self.first, self.waiting = 0, 0, None, False, []

    def add(self, n: int, least: int, with_repeats: int, once: int, leaves: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)
        self.with_repeats += with_repeats
        self.once += once
        self.leaves += leaves


class Patricia:
    """One range of sorted strings. before, after: blocks that its first and last string share with the neighbours' strings.

    Rows of out: [own digest if shared, conv_id, depth, parent's conv_id, parent's digest if that is shared, n_convs, n_children,
    n_leaves, bytes with repeats, bytes once, ends_sha256]."""

    def __init__(self, before: int | None, after: int | None):
        #: depth up to which the first and the last string's nodes are shared; the root always is
        self.before, self.after = before, after
        self.left, self.right = (0 if x is None else x for x in (before, after))
        self.out: list[list] = []
        self.stack = [Point(0)]
        self.key, self.started = b"", False

    def _size(self, d: int) -> int:
        return int.from_bytes(self.key[d * BLOCK - LENGTH : d * BLOCK], "big")

    def _code(self, d: int) -> bytes:
        return code_of(self.key[: d * BLOCK])

    def add(self, key: bytes, n: int, least: int, ends_sha256: str) -> None:
        depth = len(key) // BLOCK
        if self.started:
            self._close(common(self.key, key), last=False)
        self.key = key
        point = self.stack[-1]
        if depth > point.depth:
            point = Point(depth)
            self.stack.append(point)
        point.add(n, least, 0, 0, 0)
        point.ends = ends_sha256
        point.first = point.first or not self.started
        if not self.started:
            for p in self.stack:
                p.first = True
        self.started = True

    def _close(self, depth: int, last: bool) -> None:
        """Close all points deeper than depth."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            above = max(depth, self.stack[-1].depth)
            if above > self.stack[-1].depth:
                branch = Point(above)
                branch.first = point.first
                self.stack.append(branch)
            self._expand(point, self.stack[-1], last)

    def _shared(self, d: int, first: bool, last: bool) -> bool:
        return (first and self.before is not None and d <= self.left) or (last and self.after is not None and d <= self.right) or d == 0

    def _expand(self, point: Point, top: Point, last: bool) -> None:
        """The nodes of the edge from `point` up to, without, `top`; `top` takes their sums."""
        first = point.first
        if not point.waiting and not (last and self.after is not None and self.right == point.depth):
            point.leaves = 1  # nothing goes on from here, in this range or the next
        with_repeats, once, below = point.with_repeats, point.once, None
        for d in range(point.depth, top.depth, -1):
            size = self._size(d)
            new = not (first and self.before is not None and d <= self.left)  # else an earlier range has counted it
            with_repeats, once = with_repeats + point.n * size, once + size * new
            code = self._code(d) if self._shared(d, first, last) else None
            at_point = d == point.depth
            row = [code, point.least, d, None, None, point.n, point.children if at_point else int(child_new), point.leaves, with_repeats, once, point.ends if at_point else None]
            self.out.append(row)
            self._parent(point.waiting if at_point else [below], point.least, code)
            below, child_new = row, new
        top.add(point.n, point.least, with_repeats, once, point.leaves)
        top.children += int(child_new)
        top.waiting.append(below)

    @staticmethod
    def _parent(rows: list[list], conv_id: int, code: bytes | None) -> None:
        for row in rows:
            row[3], row[4] = (None, code) if code is not None else (conv_id, None)

    def finish(self) -> list[list]:
        if not self.started:
            return []
        self._close(0, last=True)
        root = self.stack[0]
        code = code_of(b"")
        alone = not root.waiting and self.after is None
        self.out.append([code, root.least, 0, None, None, root.n, root.children, root.leaves + alone, root.with_repeats, root.once, root.ends])
        self._parent(root.waiting, root.least, code)
        return self.out


def code_of(key: bytes) -> bytes:
    """The digest that stands for a string in joins."""
    return hashlib.sha256(key).digest()[:DIGEST]


NODE = "code binary, conv_id long, depth long, parent_conv_id long, parent_code binary, n_convs long, n_children long, n_leaves long, with_repeats long, once long, ends_sha256 string"


def sorted_strings(seqs: DataFrame) -> DataFrame:
    """The strings in ranges, each sorted, stored with the range's number."""
    ordered = seqs.repartitionByRange("key").withColumn("run", F.spark_partition_id())
    return materialise(ordered, "trie-runs")


def neighbours(runs: DataFrame) -> dict[int, tuple[int | None, int | None]]:
    """For each range, the blocks that its first (last) string shares with the last (first) one of the range before (after) it. A row a range."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            shared = [common(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared, pa.int32())], names=["run", "shared"])

    edge = materialise(runs.groupBy("run").agg(F.min("key").alias("first"), F.max("key").alias("last")), "trie-edges")
    order = sorted(r.run for r in edge.select("run").collect())
    follows = dict(zip(order[1:], order[:-1], strict=True))
    if not follows:
        return dict.fromkeys(order, (None, None))
    links = edge.sparkSession.createDataFrame(sorted(follows.items()), "run int, prior int")
    pairs = edge.select("run", "first").join(links, "run").join(edge.select(F.col("run").alias("prior"), F.col("last").alias("end")), "prior").select("run", "end", "first")
    left = {r.run: r.shared for r in ready(pairs).mapInArrow(run, "run int, shared int").collect()}
    right = {follows[r]: n for r, n in left.items()}
    return {r: (left.get(r), right.get(r)) for r in order}


def grow(runs: DataFrame, beside: dict[int, tuple[int | None, int | None]]) -> DataFrame:
    """Nodes of each range, stored: whole ones, and parts of those that ranges share."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in NODE.split(", ")]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string()]

        def rows(nodes):
            for a in range(0, len(nodes), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*nodes[a : a + 10_000], strict=True), kinds, strict=True)], names=names)

        tree, at = None, None
        for b in batches:
            for r, *string in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != at:
                    if tree:
                        yield from rows(tree.finish())
                    at, tree = r, Patricia(*beside[r])
                tree.add(*string)
        if tree:
            yield from rows(tree.finish())

    dealt = ready(runs).repartition("run").sortWithinPartitions("run", "key").select("run", "key", "n", "least", "ends_sha256")
    return materialise(dealt.mapInArrow(run, NODE), "trie-nodes")


def build(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, key): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    coded = materialise(conversations.withColumn("code", F.unhex(F.left(F.sha2("key", 256), F.lit(2 * DIGEST)))), "trie-conversations")
    seqs = coded.groupBy("key", "code").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).join(ends(coded), "code")
    runs = sorted_strings(seqs)
    nodes = grow(runs, neighbours(runs))
    total = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "with_repeats", "once")}
    shared = nodes.where("code is not null").groupBy("code", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_code").alias("parent_code"), *total.values(), F.max("ends_sha256").alias("ends_sha256")
    )
    shared = materialise(shared, "trie-shared")
    few = F.broadcast if shared.count() <= FEW else lambda side: side
    parents = few(shared.select(F.col("code").alias("parent_code"), F.col("conv_id").alias("shared_parent")))
    every = nodes.where("code is null").drop("code").unionByName(shared.drop("code").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = every.join(parents, "parent_code", "left")
    return out.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "shared_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("with_repeats") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", share: int = 5, most: int = 9) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    own = materialise(strings(turns, id, turn, role, text), "trie-turns")
    return build(rebuilt(own, share, most))
