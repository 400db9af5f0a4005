"""Readers: nested transcript JSON, metadata CSV, manifests, media listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import media, text

WORD = "struct<text:string,start:double,end:double,score:double>"
ALIGNMENT = f"struct<id:string,start:double,end:double,text:string,duration:double,score:double,words:array<{WORD}>>"
CHUNK = "struct<id:string,start:double,end:double,text:string,language:string,duration:double,language_prob:double,audio_frames:bigint,num_logits:bigint>"
SPEECH = f"struct<speech_id:string,start:double,end:double,duration:double,text:string,probs_path:string,text_spans:array<array<int>>,audio_frames:bigint,metadata:string,chunks:array<{CHUNK}>,alignments:array<{ALIGNMENT}>>"
TRANSCRIPT = f"audio_path string, sample_rate int, duration double, id string, metadata string, speeches array<{SPEECH}>"
METADATA = ("referenskod", "namn", "extraid", "bildid")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, with its path. Files that are no JSON, or lack the path, rate or duration, are an error."""
    df = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("mode", "FAILFAST").option("primitivesAsString", False).json(path)
    need = F.col("audio_path").isNotNull() & F.col("sample_rate").isNotNull() & F.col("duration").isNotNull()
    path_ok = F.when(need, F.col("audio_path")).otherwise(F.raise_error(F.concat(F.lit("a required field is missing in "), F.input_file_name())))
    return df.withColumn("file", F.input_file_name()).withColumn("audio_path", path_ok)


def read_manifest(spark: SparkSession, path: str, key: str = "bildid") -> DataFrame:
    """All columns of a `;` file as strings; rows with a key."""
    df = spark.read.option("sep", ";").option("header", True).csv(path)
    return df.where(F.coalesce(F.col(key), F.lit("")) != "")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """referenskod, namn, extraid, bildid: values trimmed, empty ones null, blank keys left out, the last of equal keys."""
    df = spark.read.option("sep", ";").option("header", True).csv(path)
    df = df.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in METADATA), F.monotonically_increasing_id().alias("__line"))
    df = last_wins(df.where("bildid <> ''"), "bildid", "__line").drop("__line")
    return df.select(*(F.col(c) if c == "bildid" else text.blank_to_null(F.col(c)).alias(c) for c in METADATA))


def list_media(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, name, length, class of files whose extension is a media one; dot files are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    df = df.withColumns({"name": media.basename(F.col("path")), "class": media.media_class(F.col("path"))})
    return df.where(~F.col("name").startswith(".") & (F.col("class") != "other"))


def read_blobs(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, stem, length, content."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return df.select("path", media.stem(F.col("path")).alias("stem"), "length", "content")


def document_language(transcripts: DataFrame) -> str | None:
    """The two-letter folder above the first file's folder, lower-cased."""
    first = transcripts.agg(F.min("file")).first()[0] or ""
    parts = first.split("/")
    code = parts[-3] if len(parts) > 2 else ""
    return code.lower() if len(code) == 2 and code.isalpha() else None
