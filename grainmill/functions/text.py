"""Words of a text index: folding of accents, stop words and stems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and what they become in the steps of Porter's published stemmer (1980).
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _accents() -> tuple[str, str]:
    """Latin letters with one or more marks, and their bare letters, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x1F00) if unicodedata.normalize("NFD", chr(c))[0].isascii()]
    return "".join(a for a, b in pairs if a != b), "".join(b for a, b in pairs if a != b)


_MARKED, _BARE = _accents()


def fold_accents(text: Column) -> Column:
    """Letters without their marks, both where a mark is part of the letter and where it follows it."""
    return F.translate(F.regexp_replace(text, r"\p{M}+", ""), _MARKED, _BARE)


def _shape(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _ends_short(w: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
    """The longest suffix that fits decides, whether or not its stem is long enough."""
    fits = [r for r in rules if w.endswith(r[0])]
    if not fits:
        return w
    old, new = max(fits, key=lambda r: len(r[0]))
    stem = w[: len(w) - len(old)]
    return stem + new if _measure(stem) >= least else w


def porter(w: str) -> str:
    """Stem of a lower-case English word."""
    if len(w) < 3:
        return w
    w = _swap(w, [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")], 0)
    if w.endswith("eed"):
        w = _swap(w, [("eed", "ee")], 1)
    else:
        for end in ("ed", "ing"):
            stem = w[: len(w) - len(end)]
            if w.endswith(end) and "v" in _shape(stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _ends_short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP_2, 1), STEP_3, 1)
    fits = [s for s in STEP_4 if w.endswith(s)]
    if fits:
        end = max(fits, key=len)
        stem = w[: len(w) - len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(words: Column) -> Column:
    """array<string> of stems; each worker keeps those of the words it has met, within a bound."""
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for s in batches:
            if len(known) > 500_000:
                known.clear()
            for w in {w for ws in s if ws is not None for w in ws} - known.keys():
                known[w] = porter(w)
            yield s.map(lambda ws: None if ws is None else [known[w] for w in ws])

    return run(words)
