"""Flat binary token files: unsigned integers of one width, 64-bit document offsets, prefix-sum bases, memory-mapped reads.

Layout of a folder: shard-NNNNN.bin holds the ids of the shard's documents one after another (little-endian, 16 bits where
the vocabulary fits, else 32); shard-NNNNN.off holds, as 64-bit integers, a count n, n + 1 offsets of documents in the
shard, and n document ids; manifest.json lists the shards in ascending id order with their bases (tokens and documents
before each), the prefix sums of the shards' counts. It is written last, under a temporary name, so a folder without it is
incomplete. Files of a retried task replace each other whole.

The ids are those of the tokenizers library for the whole text. A text is cut at single spaces between printable
characters, and between Latin letters and plain punctuation, where this byte-level scheme always begins a new token; each
distinct part is encoded by the library once and kept in a bounded store.

Defined results: a null text is an empty text (only the end id); rows are ordered by id (nulls first); rows of one id follow
one another, those of equal texts too, in any order else, and may lie in several shards; the id -2**63 stands for null and is
read as null; an empty table gives an empty folder and result.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import kernel
from tidewater.llm.common import filesystem, within, write_committed
from tidewater.session import ready

SLICE = 4 << 20
#: Bytes of text that a shard holds on average, at most.
SHARD = 512 << 20
#: Distinct parts that a worker process keeps.
STORE = 1_500_000
_SIMPLE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?*%&#$]+")
_PRINT = np.zeros(256, bool)
_PRINT[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = kernel.table(b".,;:!?*%&#$")


def _byte_letters() -> dict[int, int]:
    """The letters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.width.itemsize == 2 else "I"
        self.space = chr(self.letters[32])
        self.known: dict[int, bytes] = {}
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        specials = kind.get("added_tokens", [])
        #: parts may be encoded one by one
        self.parts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer") and not any(" " in s["content"] or s["lstrip"] or s["rstrip"] for s in specials)

    def part(self, text: str) -> bytes:
        if _SIMPLE.fullmatch(text):
            spelled = text.replace(" ", self.space) if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tokenizer.model.tokenize(spelled)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def encode(self, column, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, offsets of texts) of an Arrow string array."""
        data, offsets = kernel.column_bytes(column)
        n = len(data)
        rows = len(offsets) - 1
        cut = np.zeros(n + 1, bool)
        if self.parts and n > 2:
            fine_next = _PRINT[data[2:]] | (data[2:] == 0xC3)
            fine_prev = _PRINT[data[:-2]]
            fine_prev[1:] |= (data[:-3] == 0xC3) & (data[1:-2] >= 0x80)
            cut[1 : n - 1] = (data[1:-1] == 32) & fine_prev & fine_next
            latin = _LETTER[data]
            latin[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cut[1:n] |= latin[:-1] & _PUNCT[data[1:]]
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        a, b = starts[:-1], starts[1:]
        keys = kernel.Hasher(data)(a, b)
        uniq, some, kind = np.unique(keys, return_index=True, return_inverse=True)
        raw = data.tobytes()
        known, made = self.known, []
        for k, x, y in zip(uniq.tolist(), a[some].tolist(), b[some].tolist(), strict=True):
            got = known.get(k)
            if got is None:
                got = self.part(raw[x:y].decode())
                if len(known) >= STORE:
                    known.clear()
                known[k] = got
            made.append(got)
        of_kind = np.concatenate([[0], np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))]) // self.width.itemsize
        flat = np.frombuffer(b"".join(made), self.width)
        size = np.diff(of_kind)[kind]
        row = np.searchsorted(offsets, a, side="right") - 1
        to = np.concatenate([[0], np.cumsum(size)])
        per_row = np.bincount(row, weights=size, minlength=rows).astype(np.int64) + 1
        of = np.concatenate([[0], np.cumsum(per_row)])
        out = np.full(int(of[-1]), end, self.width)
        place = np.arange(int(to[-1]))
        out[place + np.repeat(row, size)] = flat[place + np.repeat(of_kind[:-1][kind] - to[:-1], size)]
        return out, of


_encoders: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(folder: str, tokenizer_path: str, end: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, attempt = task.partitionId(), f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        encoder = load(tokenizer_path)
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # 16 bytes a document

        def chunks():
            for whole in batches:
                for batch in within(whole, SLICE):
                    flat, of = encoder.encode(batch.column(1), end)
                    sizes.append(np.diff(of))
                    ids.append(batch.column(0).fill_null(-1 << 63).to_numpy(zero_copy_only=False))
                    yield flat.tobytes()

        def places():
            docs, at = sum(map(len, sizes)), 0
            yield np.array([docs, 0], "<i8").tobytes()
            for part in sizes:
                if len(part):
                    yield (np.cumsum(part) + at).astype("<i8").tobytes()
                    at += int(part.sum())
            for part in ids:
                yield part.astype("<i8").tobytes()

        write_committed(f"{folder}/shard-{shard:05d}.bin", attempt, chunks())
        write_committed(f"{folder}/shard-{shard:05d}.off", attempt, places())
        counts = (shard, sum(map(len, sizes)), sum(int(p.sum()) for p in sizes), encoder.width.itemsize)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(counts, kinds, strict=True)], names=["shard", "docs", "tokens", "width"])

    return run


def write(docs: DataFrame, folder: str, tokenizer_path: str, end: int = 2, id: str = "doc_id", text: str = "text") -> dict:
    """Write the folder and return its manifest. Integer ids.

    Shards are ranges of ids, as many as Spark's shuffles have partitions, or more where these would exceed SHARD bytes of text.
    Rows of one id may lie in several shards, in any order."""
    pick = ready(docs).select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = pick.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = -(-total // SHARD) if total > SHARD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    keys = ("doc_id", "hash", "row")  # the last two cut an id that very many rows share
    ranged = pick.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = ranged.repartitionByRange(many, *keys) if many else ranged.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys).select("doc_id", "text")
    # one row a shard
    shards = sorted(ordered.mapInArrow(_write(folder, tokenizer_path, end), "shard int, docs long, tokens long, width int").collect())
    tokens = docs_before = 0
    out = {"width": max([s.width for s in shards], default=2), "end": end, "shards": []}
    for s in shards:
        if s.docs:
            out["shards"].append({"name": f"shard-{s.shard:05d}", "docs": s.docs, "tokens": s.tokens, "docs_before": docs_before, "tokens_before": tokens})
            tokens, docs_before = tokens + s.tokens, docs_before + s.docs
    write_committed(f"{folder}/manifest.json", uuid.uuid4().hex[:8], [json.dumps(out).encode()])
    return out


class Ranged:
    """Numbers in a file of any store; slices of them are read when they are asked for."""

    def __init__(self, system, path: str, kind: np.dtype, first: int = 0, n: int | None = None):
        self.file, self.kind, self.first = system.open_input_file(path), np.dtype(kind), first
        self.n = self.file.size() // self.kind.itemsize - first if n is None else n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, which: slice) -> np.ndarray:
        a, b, _ = which.indices(self.n)
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at(max(0, b - a) * size, (self.first + a) * size), self.kind)


class Shard:
    """A shard's ids, offsets and document ids: memory-mapped where the folder is a local path, read in slices elsewhere."""

    def __init__(self, folder: str, name: str, width: int, ranged: bool = False):
        system, path = filesystem(f"{folder}/{name}")
        kind = np.dtype(f"<u{width}")
        if system.type_name == "local" and not ranged:
            head = np.memmap(f"{path}.off", "<i8", "r")
            n = int(head[0])
            empty = not os.path.getsize(f"{path}.bin")
            self.ids = np.zeros(0, kind) if empty else np.memmap(f"{path}.bin", kind, "r")
            self.of, self.doc_ids = head[1 : n + 2], head[n + 2 : 2 * n + 2]
        else:
            n = int(Ranged(system, f"{path}.off", "<i8")[0:1][0])
            self.ids = Ranged(system, f"{path}.bin", kind)
            self.of, self.doc_ids = Ranged(system, f"{path}.off", "<i8", 1, n + 1), Ranged(system, f"{path}.off", "<i8", n + 2, n)


def _read(folder: str, width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name, width)
                for at in range(0, len(shard.doc_ids), 10_000):
                    of = np.asarray(shard.of[at : at + 10_001])
                    flat = np.asarray(shard.ids[of[0] : of[-1]]).astype("<u4").tobytes()
                    edges = ((of - of[0]) * 4).tolist()
                    crc = [zlib.crc32(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    ids = np.asarray(shard.doc_ids[at : at + 10_000])
                    cols = [pa.array(ids, mask=ids == -1 << 63), pa.array(of[:-1] + base), pa.array(np.diff(of)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of a complete folder: a row a document."""
    system, path = filesystem(f"{folder}/manifest.json")
    with system.open_input_stream(path, compression=None) as f:
        manifest = json.loads(f.read())
    rows = [(s["name"], s["tokens_before"]) for s in manifest["shards"]]
    shards = ready(spark.createDataFrame(rows, "name string, base long")).repartition(max(1, len(rows)))
    return shards.mapInArrow(_read(folder, manifest["width"]), "doc_id long, start long, n_tokens long, ids_crc32 long")
