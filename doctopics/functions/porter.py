"""Porter (1980) suffix stripping with the usual toolkit extensions, one word at a time.

Used only inside an Arrow UDF; repeated words are answered from a bounded per-worker cache.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Words the extended algorithm maps directly.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# Suffix tables of steps 2, 3 and 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """The word as a string of c (consonant) and v (vowel); y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape.endswith("cvc") and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if not _has_vowel(stem):
                continue
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


def _final_y(w: str) -> str:
    stem = w[:-1]
    return stem + "i" if w.endswith("y") and len(stem) > 1 and _shape(stem)[-1] == "c" else w


def _derivation(w: str) -> str:
    for suffix, new in STEP2:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) == 0:
                return w
            return _derivation(stem + new) if suffix == "alli" else stem + new
    if w.endswith("logi") and _measure(w[:-3]) > 0:
        return w[:-1]
    return w


def _ending(w: str) -> str:
    for suffix, new in STEP3:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else w
    return w


def _residue(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            allowed = _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if allowed else w
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _derivation, _ending, _residue, _tidy):
        word = step(word)
    return word
