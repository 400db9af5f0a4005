"""A corpus pipeline of five stages; part of the subpackage tidewater.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet into the shared
folder and reads it again for the next one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, minhash, pii, quality, tokens
from tidewater.llm.common import materialise
from tidewater.llm.queries import vocabulary


#: Percent of their windows of five words that near copies share.
NEAR = 80
#: Rows of an Arrow batch, at most: by Spark's default 10,000 texts of any length lie in the JVM's and Python's memory at once, in each task.
BATCH_ROWS = 2000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Each row is judged by itself: rows that share an id may differ in their verdicts.

    Null and empty texts have no words and go; a null language or source is a value of its own; repeated rows fare alike, and so
    do rows with equal statistics. Texts are judged whole, whatever their length. Other columns stay, whatever their names. An
    empty table stays empty."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, null ids last; of repeated rows and of rows that share this id, one.

    Texts without words, null ones too, are linked with nothing and stay. Shingles are those of whole texts, whatever their length.
    Other columns stay, whatever their names. An empty table stays empty."""
    return minhash.deduplicate(docs, percent=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row is judged by its text alone: null and empty texts stay, repeated rows fare alike.

    Texts are searched whole, whatever their length. Other columns stay, whatever their names. An empty table stays empty, and an
    empty benchmark drops nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows. Null texts stay null; overlapping spans are one.

    Texts are searched whole, whatever their length; of spans that begin at one place the one that ends first gives the kind. Repeated
    rows fare alike, other columns stay, whatever their names. An empty table stays empty."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless of each row, encoded with merge-dropout and decoded again. Null texts are empty: no tokens.

    Rows with equal ids and texts are encoded alike. Texts are encoded whole, whatever their length; columns other than id and text
    play no part. An empty table gives no row."""
    return tokens.encode(docs, vocabulary("piece_bpe_32k.model"), 0.1, seed=7, keep=("n_tokens", "ids_crc32", "lossless"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", sentencepiece),
]

ORACLE_SQL = None


def _small_batches(stage):
    """The stage with batches of BATCH_ROWS, which decide memory only. Its result is computed later, so the session keeps the setting."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
            spark.conf.set(rows, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _small_batches(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
