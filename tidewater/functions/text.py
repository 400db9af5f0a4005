"""Text and time functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are operators in queries.
OPERATORS = ("and", "or", "not", "near")
WORD = r"[\p{L}\p{N}_]+"
#: Letters with marks, and the letters they fold to.
MARKED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def fold(text: Column) -> Column:
    return F.translate(text, MARKED, PLAIN)


def query_terms(query: str) -> list[str]:
    """Lower-cased words of a query without its operators; duplicates stay."""
    return [t for t in (w.lower() for w in re.findall(r"\w+", query)) if t not in OPERATORS]


def query_terms_col(query: Column) -> Column:
    return F.filter(tokens(query), lambda t: ~t.isin(*OPERATORS))


def edge_strip(word: Column) -> Column:
    """Without characters other than letters, digits and underscores at both ends."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def ascii_word_match(words: Column, terms: Column) -> Column:
    """Like word_match, but only A-Z, a-z, 0-9 and _ count as characters of a word at its ends: å at an end is stripped."""
    bare = lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "")
    return F.filter(words, lambda w: F.array_contains(terms, F.lower(bare(w))))


def word_match(words: Column, terms: Column) -> Column:
    """Words (in order, repeats kept) that are query terms once stripped and lower-cased."""
    return F.filter(words, lambda w: F.array_contains(terms, F.lower(edge_strip(w))))


def html_escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def highlight(text: Column, terms: list[str]) -> Column:
    """Escaped text with every occurrence of a term, inside words too, in <mark>."""
    if not terms:
        return html_escape(text)
    any_of = "|".join(re.sub(r"([^\w])", r"\\\1", t) for t in terms)
    return F.regexp_replace(html_escape(text), f"(?iu)({any_of})", "<mark>$1</mark>")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _clock(total: Column, hours_always: bool = False, short: bool = False) -> Column:
    h, m, s = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    hour = h.cast("string") if short else F.when(h < 100, _two(h)).otherwise(h.cast("string"))  # lpad cuts what is longer
    long = F.concat(hour, F.lit(":"), _two(m), F.lit(":"), _two(s))
    brief = F.concat(m.cast("string") if short else _two(m), F.lit(":"), _two(s))
    return long if hours_always else F.when(h > 0, long).otherwise(brief)


def timecode(seconds: Column) -> Column:
    """MM:SS or HH:MM:SS, seconds rounded half to even."""
    return _clock(F.bround(seconds.cast("double"), 0).cast("long"))


def timecode_ms(seconds: Column) -> Column:
    """With milliseconds of the fraction, rounded, so that 1000 may appear."""
    s = seconds.cast("double")
    whole = s.cast("long")
    ms = F.bround((s - whole) * 1000, 0).cast("long")
    return F.concat(_clock(whole), F.lit("."), F.when(ms > 999, ms.cast("string")).otherwise(F.lpad(ms.cast("string"), 3, "0")))


def fmt_time(seconds: Column) -> Column:
    """M:SS or H:MM:SS, seconds rounded half up."""
    return _clock(F.floor(seconds.cast("double") + 0.5).cast("long"), short=True)


def duration(seconds: Column) -> Column:
    """MM:SS or HH:MM:SS, seconds rounded half up."""
    return _clock(F.floor(seconds.cast("double") + 0.5).cast("long"))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, cut to milliseconds."""
    ms = F.floor(seconds.cast("double") * 1000).cast("long")
    return F.concat(_clock(F.floor(ms / 1000).cast("long"), hours_always=True), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def bytes_fmt(n: Column) -> Column:
    """Size in B, kB, MB or GB of 1024 each, one decimal but for B."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for i, unit in enumerate(("kB", "MB", "GB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", n / 1024**i), F.lit(f" {unit}"))).otherwise(out)
    return out


def whisper_segments(raw: Column) -> Column:
    """Segments (start, end, text) of `<|0.00|>text<|2.50|>` tokens; texts are trimmed, blank ones dropped."""
    p = r"<\|(\d+(?:\.\d+)?)\|>([^<]*?)<\|(\d+(?:\.\d+)?)\|>"
    part = lambda k: F.regexp_extract_all(raw, F.lit(p), F.lit(k))
    rows = F.arrays_zip(part(1).alias("a"), part(2).alias("t"), part(3).alias("b"))
    made = F.transform(rows, lambda r: F.struct(r["a"].cast("double").alias("start"), r["b"].cast("double").alias("end"), F.trim(r["t"]).alias("text")))
    return F.filter(made, lambda s: s.text != "")


def to_srt(segments: Column, whole: Column, end: Column) -> Column:
    """SRT text of segments, or one cue of the whole text when there are none."""
    only = F.array(F.struct(F.lit(0.0).alias("start"), end.cast("double").alias("end"), whole.alias("text")))
    cues = F.when(F.size(segments) > 0, segments).otherwise(only)
    lines = F.transform(cues, lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(s.start), F.lit(" --> "), srt_time(s.end), F.lit("\n"), s.text, F.lit("\n")))
    return F.array_join(lines, "\n")


def to_txt(text: Column) -> Column:
    return F.concat(F.trim(text), F.lit("\n"))


def end_ms(segments: Column) -> Column:
    """The last segment's end in whole milliseconds, rounded half up; null without segments."""
    return F.floor(F.try_element_at(segments, F.lit(-1)).end * 1000 + 0.5).cast("long")


def language_token(raw: Column) -> Column:
    """A language code without the marks around it."""
    return F.regexp_replace(raw, r"^[<|>]+|[<|>]+$", "")


def valid_label(code: Column) -> Column:
    return code.rlike("^[a-z_]{2,10}$")


def valid_doc_id(doc_id: Column) -> Column:
    return doc_id.rlike("^[a-f0-9]{16}$")


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def export_name(started: Column, language: Column) -> Column:
    return F.concat(F.lit("transcript-"), F.date_format(started, "yyyyMMdd-HHmmss"), F.lit("-"), language)


def progress(status: Column, index: Column, total: Column) -> Column:
    running = F.least(F.lit(100.0), (F.coalesce(index, F.lit(0)) + 1) / F.coalesce(total, F.lit(1)) * 100)
    return F.when(status == "done", 100.0).when(status.isin("error", "queued"), 0.0).when(status == "decoding", 2.0).otherwise(running)


def tone(embed_ok: Column, rerank_ok: Column) -> Column:
    up = F.coalesce(embed_ok, F.lit(False)).cast("int") + F.coalesce(rerank_ok, F.lit(False)).cast("int")
    return F.when(up == 2, "green").when(up == 1, "amber").otherwise("red")
