"""Snowball stemmers for English and Swedish, by the published algorithms; run once for each distinct term."""

from __future__ import annotations

import re

#: Fixed values of the published English algorithm: whole words with stems of their own, and words that stay.
WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay after plurals are cut.
STAY = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings after which the first region starts.
BEGINNINGS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Suffixes and what takes their place in the first region, in two steps, and those that go in the second region.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: Fixed values of the published Swedish algorithm.
SWEDISH = (
    "a", "arna", "erna", "heterna", "orna", "ad", "e", "ade", "ande", "arne", "are", "aste", "en", "anden", "aren", "heten", "ern", "ar",
    "er", "heter", "or", "as", "arnas", "ernas", "ornas", "es", "ades", "andes", "ens", "arens", "hetens", "erns", "at", "andet", "het", "ast", "s",
)
SWEDISH_PAIRS = ("dd", "gd", "nn", "dt", "gt", "kt", "tt")
SWEDISH_LAST = {"lig": "", "ig": "", "els": "", "löst": "lös", "fullt": "full"}

_REGION = {"english": re.compile("[aeiouy][^aeiouy]"), "swedish": re.compile("[aeiouyäåö][^aeiouyäåö]")}
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _ending(word: str, suffixes) -> str:
    """The longest of the suffixes that the word ends in, or nothing."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _region(word: str, language: str, start: int = 0) -> int:
    """Where the part after the first vowel and non-vowel begins."""
    found = _REGION[language].search(word, start)
    return found.end() if found else len(word)


def _inflected(word: str, r1: int) -> str:
    """Without -ed, -ing and their adverbs."""
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = word[: len(word) - len(end)]
    if end in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not end or not re.search("[aeiouy]", base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    return base + "e" if r1 >= len(base) and _SHORT.search(base) else base


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WORDS:
        return WORDS[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    r1 = next((len(b) for b in BEGINNINGS if word.startswith(b)), None) or _region(word, "english")
    r2 = _region(word, "english", r1)
    word = word.removesuffix(_ending(word, ("'", "'s", "'s'")))
    end = _ending(word, ("sses", "ied", "ies", "s", "us", "ss"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[: -2 if len(word) > 4 else -1]
    elif end == "s" and re.search("[aeiouy].", word[:-1]):
        word = word[:-1]
    if word in STAY:
        return word
    word = _inflected(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    for step in (SECOND, THIRD):
        end = _ending(word, step)
        base = word[: len(word) - len(end)]
        blocked = (end == "li" and base[-1:] not in tuple("cdeghkmnrt")) or (end == "ogi" and not base.endswith("l")) or (end == "ative" and len(base) < r2)
        if end and len(base) >= r1 and not blocked:
            word = base + step[end]
    end = _ending(word, FOURTH)
    base = word[: len(word) - len(end)]
    if end and len(base) >= r2 and (end != "ion" or base.endswith(("s", "t"))):
        word = base
    at = len(word) - 1
    if (word.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT.search(word[:-1])))) or (word.endswith("ll") and at >= r2):
        word = word[:-1]
    return word.lower()


def swedish(word: str) -> str:
    r1 = max(_region(word, "swedish"), 3)
    end = _ending(word[r1:], SWEDISH)
    if end and (end != "s" or word[-2] in "bcdfghjklmnoprtvy"):
        word = word[: -len(end)]
    if _ending(word[r1:], SWEDISH_PAIRS):
        word = word[:-1]
    end = _ending(word[r1:], SWEDISH_LAST)
    return word[: len(word) - len(end)] + SWEDISH_LAST[end] if end else word


LANGUAGES = {"english": english, "swedish": swedish}


def stem(word: str, language: str = "english") -> str:
    """The stem of a lower-case word."""
    return LANGUAGES[language](word)


def stems(vocab, language: str = "english"):
    """The frame with a column `stem` for its column `term`."""
    from pyspark.sql import functions as F

    from tidewater.session import ready

    @F.pandas_udf("string")
    def run(terms):
        return terms.map(lambda t: stem(t, language))

    return ready(vocab).withColumn("stem", run("term"))
