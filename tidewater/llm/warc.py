"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id: shard bounds come from bytes over ranges of ids (ranges that hold too many are cut again), so
the same table always gives the same shards. A shard's task streams its sorted records into gzip members, rolls
to the next file once a file's compressed size passes `roll`, regenerates all headers and digests from the payloads, writes
under temporary names and renames. The manifest, written last, lists the files; readers read what it lists.

Of records with equal payloads, that with the largest id is a response and the others are revisits of it.

Defined results: a null payload is empty; null ids sort first and count as smaller than any id; repeated rows give a record
each, of which the first is the response where their id is the group's largest; an id that very many rows share stays in
one shard, which its task streams. An empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import discard, filesystem, materialise, write_committed
from tidewater.session import ready

DATE = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
FANOUT = 1024
#: Shards of a table at most; those of larger tables take more records each.
SHARDS = 1 << 16


def shard_bounds(sizes: DataFrame, per_shard: int) -> list[int]:
    """Ascending ids at which a new shard begins. sizes: non-null longs `id` and `size`, the weight of a record.

    A shard is a run of ranges of ids; ranges that weigh more than per_shard / 4 are cut FANOUT ways, again and again, until
    they are small or hold one id. The driver sees weights of ranges only: FANOUT at first, then of crowded ranges' parts, and
    bounds of about SHARDS shards at most."""
    lo, hi, total = sizes.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    if total is None:
        return []
    per_shard = max(per_shard, -(-total // SHARDS))
    width = max(1, -(-(hi - lo + 1) // FANOUT))
    cell = lambda w: F.floor((F.col("id").cast("decimal(20,0)") - F.lit(lo)) / F.lit(w)).cast("long")
    weights = {lo + r.c * width: (width, r.n) for r in sizes.groupBy(cell(width).alias("c")).agg(F.sum("size").alias("n")).collect()}
    while True:
        full = {s: w for s, (w, n) in weights.items() if n > per_shard / 4 and w > 1}
        crowded = [(s, s + w) for s, w in full.items() if w == width]
        if not crowded or width == 1:
            break
        narrow = max(1, -(-width // FANOUT))
        spans = F.broadcast(sizes.sparkSession.createDataFrame(crowded, "a long, b long"))  # at most 4 x total / per_shard spans, far under the shards' own number
        part = sizes.join(spans, F.expr("id >= a and id < b")).groupBy("a", F.floor((F.col("id") - F.col("a")) / narrow).cast("long").alias("c")).agg(F.sum("size").alias("n")).collect()
        for s, _ in crowded:
            del weights[s]
        weights |= {r.a + r.c * narrow: (narrow, r.n) for r in part}
        width = narrow
    bounds, have = [], 0
    for s in sorted(weights):
        if have and have + weights[s][1] > per_shard:
            bounds.append(s)
            have = 0
        have += weights[s][1]
    return bounds


def _record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), *fields]
    head.append(("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()))
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _clean(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str, roll: int, level: int):
    """Rows (shard, id, digest, kind, canon, url, payload), sorted. kind 0: the id and digest are revisits of canon; 1: a record."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done = []
        shard = seq = None
        buffer, size, n = [], 0, 0
        note, last, ordinal = None, None, 0

        def flush():
            nonlocal buffer, size, n, seq
            if n:
                name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                write_committed(f"{folder}/{name}", attempt, buffer)
                done.append((name, shard, seq, n, size))
                seq += 1
            buffer, size, n = [], 0, 0

        def add(data: bytes):
            nonlocal size
            buffer.append(_member(data, level))
            size += len(buffer[-1])

        for batch in batches:
            cols = [batch.column(i) for i in range(7)]
            for r in range(batch.num_rows):
                at, id_, sha, kind, canon, url = (c[r].as_py() for c in cols[:6])
                if at != shard:
                    flush()
                    shard, seq = at, 0
                if kind == 0:
                    note = (id_, sha, canon)
                    continue
                if not n:
                    fields = [("Content-Type", "application/warc-fields"), ("WARC-Filename", f"part-{shard:06d}-{seq:05d}.warc.gz")]
                    add(_record("warcinfo", f"{shard}/{seq}", fields, b"software: tidewater\r\nformat: WARC File Format 1.1\r\n"))
                payload = (cols[6][r].as_py() or "").encode("utf-8", "surrogatepass")
                raw = hashlib.sha1(payload).digest()
                b32 = base64.b32encode(raw).decode()
                ordinal = ordinal + 1 if last == (id_, sha) else 0
                last = (id_, sha)
                revisit, target = (True, note[2]) if note is not None and note[:2] == (id_, sha) else (ordinal > 0, id_)
                fields = [("WARC-Target-URI", _clean(url or f"urn:page:{id_}")), ("WARC-Payload-Digest", f"sha1:{b32}"), ("X-Page-ID", "" if id_ is None else str(id_)), ("X-Payload-Length", str(len(payload)))]
                fields.append(("Content-Type", "application/http; msgtype=response"))
                if revisit:
                    fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                    fields.append(("X-Refers-To-Page-ID", "" if target is None else str(target)))
                    fields.append(("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{target}/{b32}/0')}>"))
                block = HTTP % len(payload) + (b"" if revisit else payload)
                add(_record("revisit" if revisit else "response", f"{id_}/{b32}/{ordinal}", fields, block))
                n += 1
                if size >= roll:
                    flush()
        flush()
        if done:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate(kinds)], names=["name", "shard", "seq", "records", "bytes"])

    return run


#: Bytes that a record's headers count for in a shard's weight.
HEADERS = 512
#: Digests that so many rows, or a share of 1 / HOT_SHARE of all rows, have are joined by broadcast: HOT_SHARE of them at most.
HOT, HOT_SHARE = 10_000, 10_000


def notes_of(sums: DataFrame) -> DataFrame:
    """id, sha, canon of the rows (id, sha) whose digest a row of a larger id has too; rows of an empty page, say, are not gathered in one task."""
    rows = sums.count()
    groups = materialise(sums.groupBy("sha").agg(F.max("id").alias("canon"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    often = max(HOT, rows // HOT_SHARE)
    hot, rest = groups.where(F.col("n") > often).select("sha", "canon"), groups.where(F.col("n") <= often).select("sha", "canon")
    many = sums.join(F.broadcast(hot), "sha")  # at most HOT_SHARE rows
    few = sums.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(rest, "sha")
    return many.unionByName(few).where(~F.col("id").eqNullSafe(F.col("canon"))).select("id", "sha", "canon").distinct()


def write(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html",
    per_shard: int = 4 << 20, roll: int | None = None, level: int = 6,
) -> None:
    """Write the records of pages and then manifest.json into the folder. Integer ids.

    per_shard: bytes of payloads and headers of a shard; more where that would give over SHARDS shards. roll: compressed bytes
    at which a file ends; by default an eighth of a shard's bytes, so that shards of usual pages have a few files."""
    rows = ready(pages).select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    data = F.coalesce("payload", F.lit("")).cast("binary")
    sums = materialise(rows.select("id", F.sha1(data).alias("sha"), (F.octet_length(data) + HEADERS).cast("long").alias("size")), "warc-digests")
    total = sums.agg(F.sum("size")).first()[0] or 0
    per_shard = max(per_shard, -(-total // SHARDS))
    roll = roll or per_shard // 8
    bounds = shard_bounds(sums.select("id", "size").where("id is not null"), per_shard)
    step = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def shard_of(ids):
        return __import__("pandas").Series(np.searchsorted(step, ids.fillna(-(1 << 63)).to_numpy(np.int64), side="right").astype(np.int32))

    # payloads move once; which ids are revisits comes from digests alone
    notes = notes_of(sums.select("id", "sha"))
    notes = notes.select("id", "sha", F.lit(0).alias("kind"), "canon", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"))
    records = rows.select("id", F.sha1(data).alias("sha"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("canon"), "url", "payload")
    both = notes.unionAll(records).withColumn("shard", shard_of("id"))
    both = both.select("shard", "id", "sha", "kind", "canon", "url", "payload")
    dealt = both.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "id", "sha", "kind", "url")
    files = materialise(dealt.mapInArrow(_write(folder, roll, level), "name string, shard int, seq int, records long, bytes long"), "warc-files")
    names = [r.asDict() for r in files.orderBy("shard", "seq").collect()]  # one row a file
    write_committed(f"{folder}/manifest.json", uuid.uuid4().hex[:8], [json.dumps({"files": names}).encode()])
    discard(sums, files)


def records(stream):
    """(headers, block) of each record of a stream of gzip members, one in memory at a time."""
    buffer, z, out = b"", None, bytearray()
    while True:
        if not buffer:
            buffer = stream.read(1 << 20)
            if not buffer:
                if z is not None:
                    raise EOFError("a gzip member is cut off")
                return
        if z is None:
            z, out = zlib.decompressobj(31), bytearray()
        out += z.decompress(buffer)
        buffer = z.unused_data
        if not z.eof:
            buffer = b""
            continue
        z = None
        head, _, rest = bytes(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield fields, block


def _read(folder: str):
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)
        number = lambda x: int(x) if x else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = filesystem(f"{folder}/{name}")
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as f:
                    for h, block in records(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        claimed = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response":
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != claimed:
                                raise ValueError(f"{name}: a payload does not have its digest")
                        rows.append((number(h["X-Page-ID"]), int(h["X-Payload-Length"]), claimed, h["WARC-Type"], number(h.get("X-Refers-To-Page-ID")), h["WARC-Target-URI"], payload if h["WARC-Type"] == "response" else None))
                        size += len(payload)
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits): a row a record."""
    system, path = filesystem(f"{folder}/manifest.json")
    with system.open_input_stream(path, compression=None) as f:
        names = [(x["name"],) for x in json.loads(f.read())["files"]]
    files = ready(spark.createDataFrame(names, "name string")).repartition(max(1, min(len(names), 4096)))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return files.mapInArrow(_read(folder), schema)
