"""Nested transcripts to chunk and document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import media, text


def contained(items: Column, start: Column, end: Column) -> Column:
    """Items whose interval lies within [start, end], both ends included; null bounds of items leave them out."""
    return F.filter(items, lambda a: F.coalesce((a.start >= start) & (a.end <= end), F.lit(False)))


def metadata_join(df: DataFrame, metadata: DataFrame | None, path: str = "audio_path") -> DataFrame:
    """The four metadata columns by the path's stem; null where there is no row."""
    if metadata is None:
        return df.withColumns({c: F.lit(None).cast("string") for c in ("referenskod", "namn", "extraid", "bildid")})
    return df.join(metadata, media.stem(F.col(path)) == metadata.bildid, "left")


def flatten(transcripts: DataFrame, metadata: DataFrame | None = None, doc_language: str | None = None) -> DataFrame:
    """One row a chunk: position in its speech, document context, the alignments that it contains."""
    s = transcripts.select("audio_path", "sample_rate", F.col("duration").alias("media_duration"), F.explode("speeches").alias("s"))
    c = s.select("audio_path", "sample_rate", "media_duration", "s", F.posexplode("s.chunks").alias("chunk_id", "c"))
    rows = c.select(
        media.doc_id(F.col("audio_path")).alias("doc_id"),
        F.coalesce(F.col("s.speech_id").try_cast("int"), F.lit(0)).alias("speech_id"),
        F.col("chunk_id").cast("int").alias("chunk_id"), "audio_path", "sample_rate", "media_duration",
        F.coalesce(text.blank_to_null(F.col("c.language")), F.lit(doc_language)).alias("language"),
        F.col("c.start").cast("float").alias("start"), F.col("c.end").cast("float").alias("end"), F.col("c.duration").cast("float").alias("duration"),
        F.coalesce("c.text", F.lit("")).alias("text"), "c.audio_frames", "c.num_logits", F.col("c.language_prob").cast("float").alias("language_prob"),
        F.to_json(contained(F.coalesce("s.alignments", F.array()), F.col("c.start"), F.col("c.end"))).alias("alignments_json"),
        F.coalesce("s.metadata", F.lit("{}")).alias("metadata"),
    )
    return metadata_join(rows, metadata)


#: Columns of a stored chunk that later jobs fill.
LATER = {"text_embedding": "array<float>", "frame_blob": "binary", "frame_mime": "string", "frame_width": "int", "frame_height": "int", "frame_embedding": "array<float>"}


def chunks(transcripts: DataFrame, metadata: DataFrame | None = None, doc_language: str | None = None) -> DataFrame:
    """flatten() in the 26 columns of a stored chunk; vectors and frames are null until their jobs fill them."""
    rows = flatten(transcripts, metadata, doc_language)
    names = "doc_id speech_id chunk_id audio_path sample_rate audio_duration referenskod namn bildid extraid start end duration text audio_frames num_logits language language_prob alignments_json metadata".split()
    rows = rows.withColumn("audio_duration", F.col("media_duration").cast("float"))
    return rows.select(*names, *(F.lit(None).cast(t).alias(c) for c, t in LATER.items()))


def documents(transcripts: DataFrame, metadata: DataFrame | None = None, base_uri: str | None = None, root: str | None = None, thumbnails: DataFrame | None = None, doc_language: str | None = None) -> DataFrame:
    """One row a media file."""
    base, absolute = F.lit(base_uri), F.concat(F.lit(root.rstrip("/") + "/"), media.basename(F.col("audio_path"))) if root else F.lit(None).cast("string")
    rows = transcripts.select(
        media.doc_id(F.col("audio_path")).alias("doc_id"), "audio_path", "sample_rate", "duration", F.lit(doc_language).alias("language"),
        F.coalesce(F.size("speeches"), F.lit(0)).alias("num_speeches"), media.mime(F.col("audio_path")).alias("media_mime"),
        media.media_uri(F.col("audio_path"), base, absolute).alias("media_blob"), F.coalesce("metadata", F.lit("{}")).alias("metadata"),
    )
    rows = metadata_join(rows, metadata)
    if thumbnails is not None:
        pics = thumbnails.select(F.col("stem").alias("__stem"), F.col("content").alias("thumbnail"))
        rows = rows.join(pics, media.stem(F.col("audio_path")) == F.col("__stem"), "left").drop("__stem")
    else:
        rows = rows.withColumn("thumbnail", F.lit(None).cast("binary"))
    return rows.withColumn("thumbnail_mime", F.when(F.col("thumbnail").isNotNull(), "image/jpeg"))


def parse_alignments(column: Column, schema: str) -> Column:
    """Parsed alignments; empty where the text is null or no JSON."""
    return F.coalesce(F.from_json(column, f"array<{schema}>"), F.array().cast(f"array<{schema}>"))


def point_in_interval(segments: Column, t: Column) -> Column:
    """The segment with start <= t < end, null in gaps."""
    return F.try_element_at(F.filter(segments, lambda s: (s.start <= t) & (t < s.end)), F.lit(1))
