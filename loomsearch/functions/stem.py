"""The Porter stemming algorithm (M. F. Porter, 1980), with the extensions that common tool kits apply by default.

Written from the published rules. Stemming is applied to the distinct vocabulary and joined back, so that each word
form is stemmed once in Python, however often it occurs.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Irregular forms whose stems the rules would miss.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffixes of the second, third and fourth step of the published algorithm.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _form(word: str) -> str:
    """The word's letters as ``c`` and ``v``; ``y`` is a vowel after a consonant."""
    out: list[str] = []
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    """Number of changes from vowels to consonants."""
    return _form(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _closed(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; a two-letter word vowel, consonant counts too."""
    form = _form(word)
    return (form.endswith("cvc") and word[-1] not in "wxy") or (len(word) == 2 and form == "vc")


def _swap(word: str, rules, least: int) -> str:
    """The longest matching suffix replaced, where the stem's measure reaches ``least``."""
    fits = [(suffix, new) for suffix, new in rules if word.endswith(suffix)]
    if fits:
        suffix, new = max(fits, key=lambda rule: len(rule[0]))
        stem = word[: len(word) - len(suffix)]
        measured = stem + suffix[:-1] if suffix == "logi" else stem
        if _measure(measured) >= least:
            return stem + new
    return word


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: len(word) - len(suffix)]
        if word.endswith(suffix) and "v" in _form(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _closed(stem) else stem
        if word.endswith(suffix):
            return word
    return word


def _final_y(word: str) -> str:
    """A final y after a consonant that isn't the first letter becomes i."""
    stem = word[:-1]
    return stem + "i" if word.endswith("y") and len(stem) > 1 and _form(stem)[-1] == "c" else word


def _second(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _second(word[:-4] + "al")
    return _swap(word, STEP_2, 1)


def _fourth(word: str) -> str:
    fits = [s for s in STEP_4 if word.endswith(s)]
    if not fits:
        return word
    suffix = max(fits, key=len)
    stem = word[: len(word) - len(suffix)]
    return stem if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))) else word


def _last(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _closed(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word; words of one or two letters are left as they are."""
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _second, lambda w: _swap(w, STEP_3, 1), _fourth, _last):
        word = step(word)
    return word


def stem_table(words: DataFrame) -> DataFrame:
    """(term, stem) of each distinct term."""

    @F.pandas_udf("string")
    def stems(values: pd.Series) -> pd.Series:
        return values.map(stem)

    return words.select("term").distinct().withColumn("stem", stems("term"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """The stems of arrays of words, in order; each worker remembers the stems of the words it meets. Null stays null."""
    return words.map(lambda each: None if each is None else [stem(w) for w in each])
