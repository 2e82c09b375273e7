"""English stems by the published Snowball rules (Porter's second stemmer), for the text search index [H2].

A word is lower-case. R1 is what follows the first consonant after a vowel, R2 the same within R1. Words that are not of
a to z and apostrophes are their own stems.
"""

from __future__ import annotations

import re

#: Fixed values of the published algorithm: suffixes with what they become, words with stems of their own, beginnings that fix R1.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
R1_AFTER = ("gener", "commun", "arsen")

_WORD = re.compile(r"[a-z']+")
#: The last letters of the suffixes of steps 2 to 4.
_ENDS_2, _ENDS_3, _ENDS_4 = (tuple(sorted({e[-2:] for e in ends})) for ends in ((*STEP_2, "ogi", "li"), (*STEP_3, "ative"), (*STEP_4, "ion")))
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, endings) -> str:  # noqa: ANN001
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    if len(word) < 3 or not _WORD.fullmatch(word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    # a y that stands for a consonant is capital meanwhile
    if "y" in w:
        w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1 = next(len(b) for b in R1_AFTER if w.startswith(b)) if w.startswith(R1_AFTER) else _region(w, 0)
    r2 = _region(w, r1)
    if "'" in w:
        w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith(("s", "ied")):
        w = _plurals(w)
    if w in AFTER_1A:
        return w
    if w.endswith(("ed", "ing", "ly")):
        w = _tenses(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _derived(w, r1, r2)
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _plurals(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")):
        return w
    return w[:-1] if w.endswith("s") and _VOWEL.search(w[:-2]) else w


def _tenses(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if not end:
        return w
    base = w[: -len(end)]
    if end in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else w
    if not _VOWEL.search(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return base[:-1]
    return base + "e" if r1 >= len(base) and _SHORT_END.search(base) else base


def _derived(w: str, r1: int, r2: int) -> str:
    end = _longest(w, (*STEP_2, "ogi", "li")) if w.endswith(_ENDS_2) else ""
    if end and len(w) - len(end) >= r1:
        base = w[: -len(end)]
        if end == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif end == "li":
            w = base if base and base[-1] in "cdeghkmnrt" else w
        else:
            w = base + STEP_2[end]
    end = _longest(w, (*STEP_3, "ative")) if w.endswith(_ENDS_3) else ""
    if end and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + STEP_3[end]
        elif len(w) - len(end) >= r2:
            w = w[: -len(end)]
    end = _longest(w, (*STEP_4, "ion")) if w.endswith(_ENDS_4) else ""
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    return w
