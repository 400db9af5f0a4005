"""Small lookup tables as map expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-letter language codes and their two-letter ones.
LANGUAGES = {
    "swe": "sv", "eng": "en", "nor": "no", "dan": "da", "fin": "fi", "isl": "is", "deu": "de", "ger": "de", "fra": "fr", "spa": "es",
    "ita": "it", "nld": "nl", "pol": "pl", "por": "pt", "rus": "ru", "ara": "ar", "zho": "zh", "cmn": "zh", "jpn": "ja", "kor": "ko",
    "tur": "tr", "ukr": "uk", "ell": "el", "gre": "el", "ces": "cs", "cze": "cs", "hun": "hu", "ron": "ro", "rum": "ro", "est": "et",
    "lav": "lv", "lit": "lt", "heb": "he", "hin": "hi", "ind": "id", "tha": "th", "vie": "vi",
}
#: Default alignment models by language.
MODELS = {"sv": "KBLab/wav2vec2-large-voxrex-swedish", "en": "facebook/wav2vec2-base-960h"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain(*values.items())))


def language(code: Column) -> Column:
    """The two-letter code; unknown codes pass through."""
    return F.coalesce(F.try_element_at(_map(LANGUAGES), code), code)


def default_model(code: Column) -> Column:
    return F.try_element_at(_map(MODELS), code)
