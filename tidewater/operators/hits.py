"""What searches return: projections, listings, lookups of hits' documents and frames, loading more."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import media
from tidewater.functions import text as T
from tidewater.operators import ingest
from tidewater.sources import transcripts

#: Columns of a hit in a plain search, and of one in a service's answer.
BRIEF = ("doc_id", "audio_path", "speech_id", "chunk_id", "start", "end", "duration", "text", "language")
FULL = ("_score", *BRIEF, "namn", "referenskod", "bildid", "extraid", "alignments")


def brief(hits: DataFrame, alignments: bool = False) -> DataFrame:
    """The nine columns of a plain search, and the alignments' JSON if it is asked for."""
    return hits.select(*BRIEF, *(["alignments_json"] if alignments else []))


def full(hits: DataFrame, score: str = "_score") -> DataFrame:
    """The fifteen columns of a service's answer, with alignments parsed (none where the JSON is null or broken)."""
    parsed = ingest.parse_alignments(F.col("alignments_json"), transcripts.ALIGNMENT)
    return hits.select(F.col(score).alias("_score"), *FULL[1:-1], parsed.alias("alignments"))


def listing(hits: DataFrame, order: list[Column], terms: list[str] | None = None) -> DataFrame:
    """rank, line: a top-k list for people, numbered from 1; with terms, the words that match and their times on lines of their own."""
    rows = hits.select(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("o"), "start", "end", "audio_path", "text", *(["alignments_json"] if terms else []))
    rows = rows.select(F.row_number().over(_window()).alias("rank"), "*")  # a top-k list: one window over it is small
    head = F.concat(F.lpad(F.col("rank").cast("string"), 2, " "), F.lit(". ["), T.timecode(F.col("start")), F.lit("→"), T.timecode(F.col("end")), F.lit("] "), media.basename(F.col("audio_path")), F.lit("\n     "), F.col("text"))
    if not terms:
        return rows.select("rank", head.alias("line"))
    words = F.flatten(F.transform(ingest.parse_alignments(F.col("alignments_json"), transcripts.ALIGNMENT), lambda a: F.coalesce(a.words, F.array().cast(f"array<{transcripts.WORD}>"))))
    wanted = F.array(*(F.lit(t) for t in terms))
    found = F.filter(words, lambda w: F.array_contains(wanted, F.lower(T.edge_strip(w.text))))
    lines = F.transform(found, lambda w: F.concat(F.lit("\n     • ["), T.timecode_ms(w.start), F.lit("] "), F.trim(w.text)))
    none = F.lit("\n     (the chunk matches, none of its words does by itself)")
    return rows.select("rank", F.concat(head, F.when(F.size(lines) > 0, F.array_join(lines, "")).otherwise(none)).alias("line"))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("o")


def one_document(documents: DataFrame, doc_id: str) -> DataFrame:
    """The row of a document, if there is one. An id that is no id of documents is an error before anything is read."""
    if not re.fullmatch(r"[a-f0-9]{16}", doc_id or ""):
        raise ValueError("invalid doc_id")
    return documents.where(F.col("doc_id") == doc_id)


def lookup(hits: DataFrame, documents: DataFrame, frames: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id", "speech_id", "chunk_id")) -> DataFrame:
    """Hits with `document` and `frame`, structs of the other tables' rows (null where there is none): one join each."""
    whole = documents.select("doc_id", F.struct(*(c for c in documents.columns if c != "doc_id")).alias("document"))
    out = hits.join(whole, "doc_id", "left")
    if frames is None:
        return out
    pics = frames.select(*keys, F.struct(*(c for c in frames.columns if c not in keys)).alias("frame"))
    return out.join(pics, list(keys), "left")


def more(search: Callable[[object], DataFrame], spec, have: int, step: int = 30) -> tuple[DataFrame, bool]:
    """(the same search with `step` hits more than the `have` ones, whether still more can come): it ends where fewer return than were asked for, or the limit is met."""
    asked = replace(spec, n=have + step)
    found = search(asked)
    n = found.count()
    return found, n >= have + step and asked.n > have


def in_order(scores: DataFrame, index: str = "index") -> DataFrame:
    """Answers that carry their question's number, in the order of the questions."""
    return scores.orderBy(index)


def first(rows: DataFrame, done: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Rows whose key is not done yet, by key, `n` at most (all without n): the limit counts what is left to do."""
    todo = rows.join(done.select(*keys), keys, "left_anti").orderBy(*keys)
    return todo if n is None else todo.limit(n)
