"""Paths, media types, byte ranges and media bytes."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Media types by extension.
MIME = {
    "mp4": "video/mp4", "mkv": "video/x-matroska", "mov": "video/quicktime", "webm": "video/webm", "avi": "video/x-msvideo",
    "m4a": "audio/mp4", "mp3": "audio/mpeg", "wav": "audio/x-wav", "flac": "audio/flac", "ogg": "audio/ogg", "opus": "audio/opus",
    "html": "text/html", "json": "application/json", "txt": "text/plain", "css": "text/css", "js": "text/javascript",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "webp": "image/webp", "ico": "image/x-icon",
    "woff": "font/woff", "woff2": "font/woff2",
}
#: Extensions of video and audio files.
VIDEO = ("mp4", "mkv", "mov", "webm", "avi", "flv")
AUDIO = ("m4a", "mp3", "wav", "flac", "ogg", "opus")
#: Bytes of a piece of a range read.
PIECE = 1 << 20


def doc_id(path: Column) -> Column:
    """The first 16 hexadecimal digits of a path's SHA-1."""
    return F.substring(F.sha1(F.encode(path, "UTF-8")), 1, 16)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Extension without its dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)\.([^.]*)$", 1))


def mime(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, kind in MIME.items():
        out = F.when(suffix(path) == ext, kind).otherwise(out)
    return out


def media_class(path: Column) -> Column:
    return F.when(suffix(path).isin(*VIDEO), "video").when(suffix(path).isin(*AUDIO), "audio").otherwise("other")


def mime_or(stored: Column, default: str = "application/octet-stream") -> Column:
    """The stored media type, or the default where it is null or empty."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.lit(default))


def percent_encoded(path: Column) -> Column:
    """A path with all but letters, digits and -._~/ as %XX of its UTF-8 bytes."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def media_uri(path: Column, base: Column, absolute: Column) -> Column:
    """base/name if there is a base, else a file URI of the absolute path, else null."""
    return F.coalesce(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), basename(path)), F.concat(F.lit("file://"), percent_encoded(absolute)))


def confined(path: Column, root: str) -> Column:
    """Whether a path stays in a folder: absolute ones below it, relative ones without a step up."""
    up = path.rlike(r"(^|/)\.\.(/|$)")
    return ~up & (~path.startswith("/") | path.startswith(root.rstrip("/") + "/"))


def audio_extension(kind: Column) -> Column:
    out = F.lit("audio")
    for ext in ("wav", "mp4", "ogg", "webm"):
        out = F.when(F.contains(kind, F.lit(ext)), ext).otherwise(out)
    return out


def range_parse(header: Column, total: Column) -> Column:
    """struct(start, end), both inclusive, of `bytes=a-b`, `bytes=a-` or `bytes=-n`, cut to the size; null if not satisfiable."""
    p = r"^\s*bytes=(\d*)-(\d*)\s*$"
    a, b = F.regexp_extract(header, p, 1), F.regexp_extract(header, p, 2)
    number = lambda x: F.expr("0") + F.when(x != "", x).cast("long")
    total = total.cast("long")
    start = F.when(a == "", F.greatest(F.lit(0), total - number(b))).otherwise(number(a))
    end = F.when(a == "", total - 1).otherwise(F.coalesce(number(b), total - 1))
    ok = header.rlike(p) & ~((a == "") & (b == "")) & (start <= end) & (start < total)
    return F.when(ok, F.struct(start.alias("start"), F.least(end, total - 1).alias("end")))


def content_range(r: Column, total: Column) -> Column:
    """Header value: the range, or the size alone where there is none."""
    return F.coalesce(F.concat(F.lit("bytes "), r.start, F.lit("-"), r.end, F.lit("/"), total), F.concat(F.lit("bytes */"), total))


def range_bytes(data: Column, r: Column) -> Column:
    return F.substring(data, (r.start + 1).cast("int"), (r.end - r.start + 1).cast("int"))


def range_pieces(data: Column, r: Column, piece: int = PIECE) -> Column:
    """The range in pieces of at most `piece` bytes."""
    return F.transform(F.sequence(r.start, r.end, F.lit(piece).cast("long")), lambda a: F.substring(data, (a + 1).cast("int"), F.least(F.lit(piece), r.end - a + 1).cast("int")))


def jpeg_size(data: bytes | None) -> tuple[int, int]:
    """(width, height) from the first start-of-frame marker after the first two bytes; (0, 0) if there is none, or where a marker is missing."""
    data = data or b""
    at, frames, bare = 2, {0xC0, 0xC1, 0xC2}, {*range(0xD0, 0xDA)}
    while at + 9 < len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in frames:
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 if marker in bare else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 0, 0


def wav_bytes(channels: list[list[float]], rate: int) -> bytes:
    """A 16-bit PCM WAV file of float channels in -1..1."""
    import numpy as np

    x = np.clip(np.array(channels, float).T.reshape(-1), -1, 1)
    pcm = np.where(x < 0, x * 0x8000, x * 0x7FFF).astype("<i2").tobytes()
    n = max(1, len(channels))
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, n, rate, rate * n * 2, n * 2, 16, b"data", len(pcm)) + pcm


def resample_mono(channels: list[list[float]], rate: int, target: int = 16_000) -> list[float]:
    """Channels averaged and linearly resampled."""
    import numpy as np

    x = np.array(channels, float)
    if not x.size:
        return []
    mono = x.mean(axis=0)
    n = round(len(mono) * target / rate)
    return np.interp(np.arange(n) * rate / target, np.arange(len(mono)), mono).tolist()


def jpeg_sizes(df: DataFrame, id: str, data: str) -> DataFrame:
    """id, width, height."""
    from tidewater.session import ready

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = [jpeg_size(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32())], names=["id", "width", "height"])

    kind = df.schema[id].dataType.simpleString()
    return ready(df).select(id, data).mapInArrow(run, f"id {kind}, width int, height int")
