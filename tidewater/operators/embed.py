"""Embedding clients as vectorised functions, with a deterministic client for use without a model server."""

from __future__ import annotations

import hashlib
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import ready


class Client(Protocol):
    def embed_text(self, texts: list[str]) -> list[list[float]]: ...

    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class Hashing:
    """Signed word hashing into a unit vector; scores are cosines."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed_text(self, texts):
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in t.lower().split():
                h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
                v[int(h[:15], 16) % self.dims] += 1.0 if h[15] >= "8" else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    def rerank(self, query, texts):
        q, *rest = self.embed_text([query, *texts])
        return [sum(a * b for a, b in zip(q, v, strict=True)) for v in rest]


#: What an embedding or reranking model is told.
EMBED_INSTRUCTION = "Represent the user's input."
RERANK_INSTRUCTION = "Given a search query, retrieve relevant candidates that answer the query."
RERANK_PREFIX = (
    "<|im_start|>system\nJudge whether the Document meets the requirements based on the Query and the Instruct provided. "
    'Note that the answer can only be "yes" or "no".<|im_end|>\n<|im_start|>user\n'
)
RERANK_SUFFIX = "<|im_end|>\n<|im_start|>assistant\n"


def data_url(image: bytes, prepare=None, mime: str = "image/jpeg") -> str:
    """An image as a data URL. prepare: a function of bytes that crops, scales and compresses; without one the bytes are sent as they are."""
    import base64

    return f"data:{mime};base64,{base64.b64encode(prepare(image) if prepare else image).decode()}"


def shortened(vector: list[float], dims: int) -> list[float]:
    """The first dims values, scaled to length one; fewer are an error."""
    if len(vector) < dims:
        raise ValueError(f"a vector of {len(vector)} dimensions is too short for {dims}")
    n = sum(x * x for x in vector[:dims]) ** 0.5 or 1.0
    return [x / n for x in vector[:dims]]


class Http:
    """A model server with /v1/embeddings (chat messages) and /v1/rerank. So many calls are under way at once; answers keep the order of what was asked."""

    def __init__(self, url: str, model: str = "embedding", rerank_url: str | None = None, rerank_model: str = "reranker", dims: int = 1024, texts: int = 16, images: int = 4, timeout: float = 120.0, prepare=None):
        self.url, self.model, self.rerank_url, self.rerank_model = url.rstrip("/"), model, (rerank_url or url).rstrip("/"), rerank_model
        self.dims, self.at_once, self.timeout, self.prepare = dims, {"text": texts, "image": images}, timeout, prepare

    def _post(self, url: str, body: dict) -> dict:
        import json
        from urllib.request import Request, urlopen

        request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def _embed(self, kind: str, contents: list[list[dict]]) -> list[list[float]]:
        from concurrent.futures import ThreadPoolExecutor

        def one(content):
            said = [("system", [{"type": "text", "text": EMBED_INSTRUCTION}]), ("user", content), ("assistant", [{"type": "text", "text": ""}])]
            body = {"model": self.model, "messages": [{"role": r, "content": c} for r, c in said], "encoding_format": "float", "continue_final_message": True, "add_special_tokens": True}
            return shortened(self._post(f"{self.url}/v1/embeddings", body)["data"][0]["embedding"], self.dims)

        if not contents:
            return []
        with ThreadPoolExecutor(self.at_once[kind]) as pool:
            return list(pool.map(one, contents))

    def embed_text(self, texts):
        return self._embed("text", [[{"type": "text", "text": t}] for t in texts])

    def embed_image(self, images):
        return self._embed("image", [[{"type": "image_url", "image_url": {"url": data_url(i, self.prepare)}}, {"type": "text", "text": ""}] for i in images])

    def rerank(self, query, texts):
        if not texts:
            return []
        asked = f"{RERANK_PREFIX}<Instruct>: {RERANK_INSTRUCTION}\n<Query>: {query}\n"
        body = {"model": self.rerank_model, "query": asked, "documents": [f"<Document>: {t}{RERANK_SUFFIX}" for t in texts]}
        results = self._post(f"{self.rerank_url}/v1/rerank", body)["results"]
        return [r["relevance_score"] for r in sorted(results, key=lambda r: r["index"])]


CLIENTS = {"hashing": Hashing, "http": Http}


def make_client(backend: str, **options) -> Client:
    if backend not in CLIENTS:
        raise ValueError(f"unknown backend {backend!r}")
    return CLIENTS[backend](**options)


def embed(df: DataFrame, keys: list[str], text: str, column: str = "embedding", backend: str = "hashing", batch: int = 256, **options) -> DataFrame:
    """keys and the vectors of a column of texts, or of images where it is binary; the client is made once a task and asked in batches."""
    image = df.schema[text].dataType.simpleString() == "binary"
    empty = b"" if image else ""

    def run(batches):
        import pyarrow as pa

        client = None
        for b in batches:
            client = client or make_client(backend, **options)
            given = [t or empty for t in b.column(len(keys)).to_pylist()]
            ask = client.embed_image if image else client.embed_text
            out = [v for i in range(0, len(given), batch) for v in ask(given[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(out, pa.list_(pa.float32()))], names=[*keys, column])

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), f"{column} array<float>"])
    return ready(df).select(*keys, text).mapInArrow(run, schema)


def reranker(query: str, text: str = "text", backend: str = "hashing", **options):
    """A scorer for fusion.rerank."""

    @F.pandas_udf("double")
    def score(texts):
        return __import__("pandas").Series(make_client(backend, **options).rerank(query, [t or "" for t in texts]))

    return lambda df: ready(df).withColumn("_relevance_score", score(text))
