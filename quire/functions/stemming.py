"""Porter stemming for the text index.

Stemming runs on the distinct vocabulary, never on running text, so the Python work grows
with the number of different words.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F, types as T



def _shape(stem: str) -> str:
    """Vowel/consonant shape, e.g. ``trees`` -> ``CCVVC``."""
    out = []
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "C")
        out.append("V" if vowel else "C")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("V+C+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("CVC") and stem[-1] not in "wxy"


# fixed values: published suffix rules (suffix, replacement), longest first per step
_STEP2 = [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"),
          ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
          "ion", "al", "er", "ic", "ou"]


def _swap(word: str, rules, least: int) -> str:
    for suffix, repl in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + repl if _measure(stem) > least else word
    return word


def porter(word: str) -> str:
    """Published suffix-stripping stem of a lower-case word."""
    if len(word) <= 2:
        return word
    # plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and progressive
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "V" in _shape(word[: -len(suffix)]):
                cut = word[: -len(suffix)]
                break
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "C" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"
    if word.endswith("y") and "V" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, _STEP2, 0)
    word = _swap(word, _STEP3, 0)
    for suffix in _STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def folded(word: str) -> str:
    """A word without diacritics."""
    return re.sub(r"[̀-ͯ]", "", unicodedata.normalize("NFKD", word))


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(porter)


@F.pandas_udf(T.StringType())
def fold(words: pd.Series) -> pd.Series:
    """Drop diacritics."""
    return words.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)
