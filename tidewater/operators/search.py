"""Requests and the search engine: normalised parameters, metadata filters, mode routing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import fts, fusion, vector

MODES = ("fts", "semantic", "visual", "hybrid", "all")
#: Hits that each kind of caller gets if it does not say.
LIMITS = {"shell": 10, "get": 20, "post": 20, "viewer": 30, "gallery": 24}


def where(language: str | None = None, namn: str | None = None, referenskod: str | None = None, extraid: str | None = None) -> Column | None:
    """Clauses joined by AND: equality for language and extraid, substring for the others, where % and _ are wildcards. Blank: no clause."""
    parts = [F.col(c) == v for c, v in (("language", language), ("extraid", extraid)) if v and v.strip()]
    parts += [F.col(c).like(f"%{v}%") for c, v in (("namn", namn), ("referenskod", referenskod)) if v and v.strip()]
    return reduce(lambda a, b: a & b, parts) if parts else None


@dataclass
class Spec:
    """A request. Values out of range are brought into it; an unknown mode is an error."""

    q: str = ""
    n: int = 20
    mode: str = "fts"
    fuzziness: int = 0
    phrase: bool = False
    weight: float | None = None
    rerank: bool = False
    filter: Column | None = None
    text_vector: list[float] | None = None
    image_vector: list[float] | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        self.q = (self.q or "").strip()
        self.n = max(1, min(100, self.n))
        self.fuzziness = max(0, min(2, self.fuzziness))
        if self.weight is not None:
            self.weight = max(0.0, min(1.0, self.weight))


def mode_of(keyword: bool, meaning: bool, image: bool) -> str:
    """The mode that the dials stand for."""
    if image:
        return "all" if meaning or keyword else "visual"
    if meaning:
        return "hybrid" if keyword else "semantic"
    return "fts"


class Unavailable(RuntimeError):
    """A service or a table that a search needs is not there."""


class Reranker:
    """Scores again what a search has found, by a column expression or a vectorised function of the frame (query's words -> scorer).

    The three hooks get the hits of their kind of search in rank order; a subclass may treat each kind in its own way."""

    def __init__(self, scorer=None, cap: int = 100):
        self.make, self.cap = scorer or (lambda terms: fusion.overlap_score(F.col("text"), terms)), cap

    def score(self, query: str, hits: DataFrame, prior: list) -> DataFrame:
        """The best `cap` hits by prior order, with `_relevance_score`, best first."""
        kept = hits.drop("_relevance_score") if "_relevance_score" in hits.columns else hits
        return fusion.rerank(kept, self.make(T.query_terms(query)), prior, self.cap)

    def rerank_fts(self, query: str, hits: DataFrame, keys: list[str]) -> DataFrame:
        return self.score(query, hits, [F.desc("_score"), *keys])

    def rerank_vector(self, query: str, hits: DataFrame, keys: list[str]) -> DataFrame:
        return self.score(query, hits, [F.col("_distance"), *keys])

    def rerank_hybrid(self, query: str, vector_hits: DataFrame, text_hits: DataFrame, keys: list[str]) -> DataFrame:
        """Each hit of either search once, vector hits before text hits."""
        both = vector_hits.drop("_distance").unionByName(text_hits.drop("_score")).dropDuplicates(keys)
        near, found = (fusion.ranked(h, n, [*o, *map(F.col, keys)]).select(*keys, "__list", "__rank") for h, n, o in ((vector_hits, 0, [F.col("_distance")]), (text_hits, 1, [F.desc("_score")])))
        first = near.unionByName(found).groupBy(*keys).agg(F.min(F.struct("__list", "__rank")).alias("__first"))
        return self.score(query, both.join(F.broadcast(first), keys), [F.col("__first"), *keys]).drop("__first")  # two top-k lists


class Engine:
    """Searches over chunks with text, and vectors of text and frames on the same keys."""

    def __init__(
        self, chunks: DataFrame, keys: list[str], text_vectors: DataFrame | None = None, frame_vectors: DataFrame | None = None,
        fusion_keys: list[str] | None = None, scorer=None, index: fts.Index | None = None, reranker: Reranker | None = None,
    ):
        """index: a stored index of the chunks by the same keys; with it no search reads all texts, and its analyzer decides on folding, stems and stop words."""
        self.chunks, self.keys, self.text_vectors, self.frame_vectors, self.index = chunks, keys, text_vectors, frame_vectors, index
        #: Keys that hits are fused by; the default leaves out speech_id, so that equal chunk numbers of a document's speeches meet.
        self.fusion_keys = fusion_keys or [k for k in keys if k != "speech_id"]
        self.scorer, self.reranker = scorer, reranker

    def _terms(self, spec: Spec, phrase: bool, fuzzy: bool) -> fts.Query:
        terms = T.query_terms(spec.q)
        if phrase and spec.phrase:
            return fts.Query(should=[tuple(w.lower() for w in spec.q.split())])
        if fuzzy and spec.fuzziness:
            terms = self.index.expand(self.chunks.sparkSession, terms, spec.fuzziness) if self.index else fts.expand(fts.vocabulary(self.chunks), terms, spec.fuzziness)
        return fts.Query(should=[(t,) for t in dict.fromkeys(terms)])

    def _fts(self, spec: Spec, k: int, phrase: bool = True, fuzzy: bool = True) -> DataFrame:
        if self.index:
            wanted = self._terms(spec, phrase, fuzzy)
            if not any(any(u) for u in self.index.analyzer.query(wanted).scored()):
                return self.chunks.limit(0).withColumn("_score", F.lit(None).cast("double"))
            found = self.index.top(self.chunks.sparkSession, wanted, k)
            own = found.select(*(F.col("key") if len(self.keys) == 1 else F.col(f"key.{c}") for c in self.keys), "_score").toDF(*self.keys, "_score")
            out = self.chunks.join(F.broadcast(own), self.keys)  # k rows
            return out if spec.filter is None else out.where(spec.filter)
        return fts.search(self.chunks, self._terms(spec, phrase, fuzzy), k, self.keys, where=spec.filter)

    def _near(self, vectors: DataFrame, query: list[float] | None, k: int, condition: Column | None) -> DataFrame:
        """Neighbours joined back to their chunks by key; `condition` applies after ranking."""
        near = vector.knn(vectors, query, k, self.keys).select(*self.keys, "_distance")
        out = self.chunks.join(F.broadcast(near), self.keys)  # at most k rows
        return out if condition is None else out.where(condition)

    def _reranked(self, spec: Spec, vector_q) -> DataFrame:
        """The n best after the reranker's hook for the mode."""
        text = None if spec.mode == "semantic" else self._fts(spec, spec.n, spec.mode == "fts", spec.mode == "fts")
        near = None if spec.mode == "fts" else self._near(self.text_vectors, vector_q, spec.n, spec.filter)
        if spec.mode == "fts":
            out = self.reranker.rerank_fts(spec.q, text, self.keys)
        elif spec.mode == "semantic":
            out = self.reranker.rerank_vector(spec.q, near, self.keys)
        else:
            out = self.reranker.rerank_hybrid(spec.q, near, text, self.keys)
        return out.orderBy(F.desc("_relevance_score"), *self.keys).limit(spec.n)

    def answer(self, spec: Spec | dict) -> tuple[int, DataFrame | str]:
        """(200, hits), (400, what is wrong with the request) or (503, what is missing): the search as a service gives it. Hits are checked to be computable."""
        try:
            spec = spec if isinstance(spec, Spec) else Spec(**spec)
            if spec.mode == "hybrid" and not spec.q:
                return 400, "hybrid needs a text query"
            asked = spec.text_vector or spec.image_vector
            if spec.mode != "fts" and (spec.q or asked):
                need = {"semantic": [self.text_vectors], "visual": [self.frame_vectors], "hybrid": [self.text_vectors], "all": []}[spec.mode]
                if any(v is None for v in need) or (need and asked is None):
                    return 503, f"{spec.mode} needs vectors and an embedded query"
            hits = self.search(spec)
            hits.schema  # noqa: B018  a wrong filter shows here
            return 200, hits
        except Unavailable as e:
            return 503, str(e)
        except Exception as e:
            return 400, f"search failed: {e}"

    def search(self, spec: Spec) -> DataFrame:
        """Hits in rank order (orderBy is part of the plan)."""
        text_q, any_q = spec.text_vector, spec.text_vector or spec.image_vector
        if not spec.q and not any_q:
            return self.chunks.limit(0)
        if spec.rerank and self.reranker and spec.mode in ("fts", "semantic", "hybrid"):
            return self._reranked(spec, any_q)
        if spec.mode == "fts":
            return self._fts(spec, spec.n).orderBy(F.desc("_score"), *self.keys)
        if spec.mode == "semantic":
            return self._near(self.text_vectors, any_q, spec.n, spec.filter).orderBy("_distance", *self.keys)
        if spec.mode == "visual":
            return self._near(self.frame_vectors, spec.image_vector or text_q, spec.n, spec.filter).orderBy("_distance", *self.keys)
        if spec.mode == "hybrid":
            a, b = self._fts(spec, spec.n, False, False), self._near(self.text_vectors, any_q, spec.n, spec.filter)
            if spec.weight is not None and not spec.rerank:
                fused = fusion.linear(a, b, self.keys, spec.weight).orderBy(F.desc("_relevance_score"), *self.keys).limit(spec.n)
                fused = fused.withColumns({"__list": F.lit(0), "__rank": F.lit(0)})
            else:
                lists = [fusion.ranked(a, 0, [F.desc("_score"), *map(F.col, self.keys)]), fusion.ranked(b, 1, [F.col("_distance"), *map(F.col, self.keys)])]
                fused = fusion.best(fusion.rrf(lists, self.keys), spec.n, self.keys, marks=True)
            hits = self.chunks.join(F.broadcast(fused), self.keys)  # at most 2 n rows
        else:
            k, lists = 3 * spec.n, []
            if spec.q:
                lists.append(fusion.ranked(self._fts(spec, k, phrase=False), 0, [F.desc("_score"), *map(F.col, self.keys)]))
            for i, (v, q) in enumerate(((self.text_vectors, any_q), (self.frame_vectors, spec.image_vector or text_q)), 1):
                if v is not None and q is not None:
                    lists.append(fusion.ranked(self._near(v, q, k, spec.filter), i, [F.col("_distance"), *map(F.col, self.keys)]))
            rest = [x for x in self.keys if x not in self.fusion_keys]
            fused = fusion.best(fusion.rrf(lists, self.fusion_keys, carry=rest), spec.n, self.fusion_keys, marks=True)
            hits = self.chunks.join(F.broadcast(fused), self.keys)  # at most n rows
        if spec.rerank:
            scorer = self.scorer or fusion.overlap_score(F.col("text"), T.query_terms(spec.q))
            return fusion.rerank(hits.drop("_relevance_score"), scorer, ["__list", "__rank", *self.keys]).drop("__list", "__rank")
        return hits.orderBy(*fusion.order(self.keys)).drop("__list", "__rank")
