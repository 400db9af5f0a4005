"""Scalar rules with expectations derived by hand."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import media, stem
from tidewater.functions import text as T


def _one(spark, make, *values):
    df = spark.createDataFrame([(*values, 0)], [*(f"c{i}" for i in range(len(values))), "z"])
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize(
    ("seconds", "code", "ms", "brief", "srt"),
    [
        (0.0, "00:00", "00:00.000", "0:00", "00:00:00,000"),
        (59.5, "01:00", "00:59.500", "1:00", "00:00:59,500"),
        (60.5, "01:00", "01:00.500", "1:01", "00:01:00,500"),
        (3599.6, "01:00:00", "59:59.600", "1:00:00", "00:59:59,600"),
        (3600.0, "01:00:00", "01:00:00.000", "1:00:00", "01:00:00,000"),
        (1.9996, "00:02", "00:01.1000", "0:02", "00:00:01,999"),
        (360000.0, "100:00:00", "100:00:00.000", "100:00:00", "100:00:00,000"),
    ],
)
def test_clocks(spark, seconds, code, ms, brief, srt):
    assert [_one(spark, f, seconds) for f in (T.timecode, T.timecode_ms, T.fmt_time, T.srt_time)] == [code, ms, brief, srt]


@pytest.mark.parametrize(("seconds", "want"), [(35999.4, "9:59:59"), (35999.5, "10:00:00"), (359999.0, "99:59:59"), (360000.0, "100:00:00"), (4e6, "1111:06:40")])
def test_short_clock_of_many_hours(spark, seconds, want):
    assert _one(spark, T.fmt_time, seconds) == want


def test_clocks_of_nothing(spark):
    """No time, no clock, as SQL's printf has it."""
    row = spark.sql("select cast(null as double) as s").select(*(f(F.col("s")) for f in (T.timecode, T.timecode_ms, T.fmt_time, T.duration, T.srt_time))).first()
    assert list(row) == [None] * 5


@pytest.mark.parametrize(
    ("header", "total", "want"),
    [("bytes=0-", 10, (0, 9)), ("bytes=-5", 10, (5, 9)), ("bytes=-0", 10, None), ("bytes=5-3", 10, None), ("bytes=10-99999", 10, None), ("bytes=2-99999", 10, (2, 9)), ("bytes=-", 10, None), ("items=0-1", 10, None), ("bytes=0-", 0, None), ("bytes=-99", 10, (0, 9))],
)
def test_ranges(spark, header, total, want):
    got = _one(spark, lambda h, n: media.range_parse(h, n), header, total)
    assert (tuple(got) if got else None) == want


def test_range_pieces(spark):
    r = F.struct(F.lit(2).cast("long").alias("start"), F.lit(8).cast("long").alias("end"))
    assert [bytes(x) for x in _one(spark, lambda d: media.range_pieces(d, r, 3), bytearray(b"0123456789"))] == [b"234", b"567", b"8"]


def test_words(spark):
    assert T.query_terms('"spring of hope" AND not near') == ["spring", "of", "hope"]
    assert _one(spark, T.edge_strip, "«ålder»,") == "ålder" and _one(spark, T.edge_strip, "_x_") == "_x_"
    terms = F.array(F.lit("göran"), F.lit("ålder"))
    assert _one(spark, lambda t: T.word_match(F.split(t, " "), terms), "Göran, «ålder» x Göran") == ["Göran,", "«ålder»", "Göran"]
    assert _one(spark, lambda t: T.highlight(t, ["amp"]), "a & b") == "a &<mark>amp</mark>; b"
    assert _one(spark, T.html_escape, "<a&b>") == "&lt;a&amp;b&gt;"
    assert _one(spark, T.language_token, "<|sv|>") == "sv"


def test_whisper_and_srt(spark):
    raw = "<|0.00|> hi <|2.50|><|2.50|>  <|3.00|><|3|>yo<|4|>"
    got = _one(spark, T.whisper_segments, raw)
    assert [tuple(x) for x in got] == [(0.0, 2.5, "hi"), (3.0, 4.0, "yo")]
    assert _one(spark, lambda r: T.to_srt(T.whisper_segments(r), F.lit("all"), F.lit(9)), "none") == "1\n00:00:00,000 --> 00:00:09,000\nall\n"


def test_paths(spark):
    assert _one(spark, media.stem, "a/.hidden") == ".hidden" and _one(spark, media.stem, "a/b.c.mp4") == "b.c"
    assert _one(spark, media.mime, "x/y.MP4") == "video/mp4" and _one(spark, media.mime, "x/y") == "application/octet-stream"
    assert _one(spark, lambda p: media.media_uri(p, F.lit("s3://b/"), F.lit(None).cast("string")), "q/w.mp4") == "s3://b/w.mp4"
    assert len(_one(spark, media.doc_id, "x")) == 16


def test_sizes_and_states(spark):
    assert [_one(spark, T.bytes_fmt, n) for n in (0, 1023, 1024, 1536, 5 << 20)] == ["0 B", "1023 B", "1.0 kB", "1.5 kB", "5.0 MB"]
    assert _one(spark, T.tone, True, False) == "amber"
    assert _one(spark, lambda s: T.progress(s, F.lit(1), F.lit(4)), "transcribing") == 50.0


def test_media_bytes():
    assert media.jpeg_size(bytes.fromhex("FFD8FFE000044A46FFC0000B0801E0028001")) == (640, 480)
    assert media.jpeg_size(b"no") == (0, 0) == media.jpeg_size(None)
    wav = media.wav_bytes([[0.0, 2.0, -1.0]], 16_000)
    assert wav[:4] == b"RIFF" and len(wav) == 50 and wav[44:] == b"\x00\x00\xff\x7f\x00\x80"
    assert len(media.resample_mono([[0.0] * 44100], 44100)) == 16_000


#: Words and their stems, for each rule of the published algorithms.
ENGLISH = """consigned consign, consignment consign, consistency consist, consolatory consolatori, consolidating consolid, consolingly consol,
consonant conson, conspicuously conspicu, conspiracy conspiraci, constables constabl, knackeries knackeri, knavish knavish, knightly knight,
knitted knit, knives knive, generate generat, generously generous, communities communiti, hoping hope, hopping hop, ties tie, cries cri, gas gas,
this this, kiwis kiwi, gaps gap, skies sky, dying die, news news, proceed proceed, relational relat, rationalization ration, happy happi, say say,
by by, enjoyed enjoy, analogies analog, hopefulness hope, agreed agre, feed feed, bed bed, disabled disabl, luxuriated luxuri, replacement replac,
adoption adopt, controll control, rate rate, cease ceas, native nativ, talking talk, stories stori, as as"""
SWEDISH = """jaktbössa jaktböss, jakten jakt, jaktkarlarne jaktkarl, jaktkarlens jaktkarl, jalusierna jalusi, jamrande jamr, japanska japansk,
jaquette jaquet, jasminen jasmin, klockan klockan, klockans klockan, klockarens klock, klocklikt klocklik, klockornas klock, klokaste klok,
klokheten klok, klo klo, i i, jämförelse jämför, dagligt dag, arbetslöst arbetslös"""


@pytest.mark.parametrize("language, pairs", [("english", ENGLISH), ("swedish", SWEDISH)])
def test_stems(language, pairs):
    pairs = [p.split() for p in pairs.split(",")]
    assert {w: stem.stem(w, language) for w, _ in pairs} == dict(pairs)


@given(st.text(alphabet="abcdeghilnorstuvyzåäöY'1_", max_size=14), st.sampled_from(["english", "swedish"]))
def test_any_word_has_a_stem(word, language):
    assert len(stem.stem(word, language)) <= len(word) + 1
