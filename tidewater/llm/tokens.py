"""Token counts by byte-pair merging, and SentencePiece encoding with seeded merge-dropout and decoding.

Defined results: a null text is an empty text and has no tokens; decoding gives it back as an empty text. Repeated rows are
encoded each, equal (id, text) rows alike. Null ids are encoded under a key of their own. An empty table gives an empty
result. The model's path is a parameter; the file is read once by each worker process.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bpe, kernel
from tidewater.llm.common import lean, within
from tidewater.session import ready

SLICE = 1 << 20


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _counts(path: str, limit: int):
    def run(batches):
        import pyarrow as pa

        model = bpe.load(path)
        for whole in batches:
            for batch in within(whole, SLICE):
                n = bpe.count_tokens(model, _texts(batch.column(1)))
                size = np.diff(kernel.column_bytes(batch.column(1))[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row a document."""
    pick = ready(docs).select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = pick.schema["doc_id"].dataType.simpleString()
    return pick.mapInArrow(lean(_counts(model_path, limit)), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def text_keys(ids: list, seed: int) -> np.ndarray:
    """The key of each text: a keyed hash of its id."""
    known = np.array([zlib.crc32(str(i).encode()) | 1 << 32 if i is not None else 0 for i in ids], np.uint64)
    return kernel.mix(known + kernel.mix(np.array([seed % (1 << 64)], np.uint64)))


def _encode(path: str, dropout: float, seed: int, keep: list[str]):
    below = int(dropout * 2**32)

    def run(batches):
        import pyarrow as pa

        model = bpe.load(path)
        for whole in batches:
            at = whole.schema.get_field_index("__text")
            for batch in within(whole, SLICE, at):
                texts = _texts(batch.column(at))
                keys = text_keys(batch.column(batch.schema.get_field_index("__id")).to_pylist(), seed)
                ids, of = bpe.encode(model, texts, keys, below)
                back = bpe.decode(model, ids, of)
                data, offsets = kernel.column_bytes(batch.column(at))
                source, o = data.tobytes(), offsets.tolist()
                ok = [b == source[x:y] for b, x, y in zip(back, o[:-1], o[1:], strict=True)]
                flat = ids.astype(np.int32)
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]
                made = {
                    "n_tokens": pa.array(np.diff(of).astype(np.int64)),
                    "ids": pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(flat)),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "decoded": pa.array(back, pa.binary()),
                    "lossless": pa.array(ok, pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("__id")), *(made[k] for k in keep)], names=["doc_id", *keep])

    return run


_KINDS = {"n_tokens": "long", "ids": "array<int>", "ids_crc32": "long", "decoded": "binary", "lossless": "boolean"}


def encode(
    docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, id: str = "doc_id", text: str = "text",
    keep: tuple[str, ...] = ("n_tokens", "ids", "lossless"),
) -> DataFrame:
    """doc_id and the columns `keep` of n_tokens, ids, ids_crc32 (ids as little-endian 32-bit integers), decoded (UTF-8), lossless."""
    pick = ready(docs).select(F.col(id).alias("__id"), F.col(text).alias("__text"))
    kind = pick.schema["__id"].dataType.simpleString()
    return pick.mapInArrow(lean(_encode(model_path, dropout, seed, list(keep))), ", ".join([f"doc_id {kind}", *(f"{k} {_KINDS[k]}" for k in keep)]))


def _decode(path: str):
    def run(batches):
        import pyarrow as pa

        model = bpe.load(path)
        for batch in batches:
            ids = batch.column(1)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = [len(x) if x is not None else 0 for x in ids.to_pylist()] if ids.null_count else np.diff(ids.offsets.to_numpy())
            of = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            texts = [b.decode("utf-8", "replace") for b in bpe.decode(model, flat, of)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(tokens: DataFrame, model_path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of token ids; bytes that are no UTF-8 (never made by encode) give U+FFFD; null ids give an empty text."""
    pick = ready(tokens).select(F.col(id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    kind = pick.schema["doc_id"].dataType.simpleString()
    return pick.mapInArrow(_decode(model_path), f"doc_id {kind}, text string")
