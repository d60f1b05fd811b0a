"""English stems by the Porter2 rules: suffixes go in stages, each bound to a region of the word.

A stage is a table of endings in one pattern, longest first; what becomes of an ending is a replacement and a condition on what stands
before it. R1 is what follows the first consonant after a vowel, R2 the same within R1.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The published tables of the English (Porter2) stemmer.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
R1_BEGINNINGS = ("gener", "commun", "arsen")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
LI_ENDINGS = "cdeghkmnrt"


def _ending(endings) -> re.Pattern:
    return re.compile(f"(?:{'|'.join(sorted(endings, key=lambda e: (-len(e), e)))})$")


VOWEL, CONSONANT = "[aeiouy]", "[^aeiouy]"
REGION = re.compile(f"{VOWEL}{CONSONANT}")
# a vowel between consonants of which the last is no w, x or Y, or a vowel that begins the word before a consonant
SHORT_END = re.compile(f"(?:{CONSONANT}{VOWEL}[^aeiouywxY]|^{VOWEL}{CONSONANT})$")
HAS_VOWEL = re.compile(VOWEL)
DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
PLURAL = _ending(["sses", "ied", "ies", "us", "ss", "s"])
PAST = _ending(["eed", "eedly", "ed", "edly", "ing", "ingly"])
SECOND, THIRD, FOURTH = _ending(STEP2), _ending(STEP3), _ending(STEP4)


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    begun = next((len(b) for b in R1_BEGINNINGS if w.startswith(b)), None)
    if begun is None:
        m = REGION.search(w)
        begun = m.end() if m else len(w)
    m = REGION.search(w, begun)
    return begun, m.end() if m else len(w)


def _plural(w: str) -> str:
    m = PLURAL.search(w)
    end, before = (m.group(), w[: m.start()]) if m else ("", w)
    match end:
        case "sses":
            return before + "ss"
        case "ied" | "ies":
            return before + ("i" if len(before) > 1 else "ie")
        case "s" if HAS_VOWEL.search(before[:-1]):
            return before
    return w


def _past(w: str, r1: int) -> str:
    m = PAST.search(w)
    if not m:
        return w
    before = w[: m.start()]
    if m.group().startswith("eed"):
        return before + "ee" if m.start() >= r1 else w
    if not HAS_VOWEL.search(before):
        return w
    if before.endswith(("at", "bl", "iz")):
        return before + "e"
    if DOUBLE.search(before):
        return before[:-1]
    return before + "e" if r1 >= len(before) and SHORT_END.search(before) else before


def _second(w: str, r1: int) -> str:
    m = SECOND.search(w)
    if not m or m.start() < r1:
        return w
    end, before = m.group(), w[: m.start()]
    if (end == "ogi" and not before.endswith("l")) or (end == "li" and before[-1:] not in LI_ENDINGS):
        return w
    return before + STEP2[end]


def _third(w: str, r1: int, r2: int) -> str:
    m = THIRD.search(w)
    if not m or m.start() < r1 or (m.group() == "ative" and m.start() < r2):
        return w
    return w[: m.start()] + STEP3[m.group()]


def _fourth(w: str, r2: int) -> str:
    m = FOURTH.search(w)
    if not m or m.start() < r2 or (m.group() == "ion" and w[m.start() - 1 : m.start()] not in ("s", "t")):
        return w
    return w[: m.start()]


def _last(w: str, r1: int, r2: int) -> str:
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or (at >= r1 and not SHORT_END.search(w[:-1]))):
        return w[:-1]
    return w[:-1] if w.endswith("ll") and at >= r2 else w


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word of small letters; words of one or two characters are their own."""
    if len(word) < 3:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = re.sub("'s'$|'s$|'$", "", word.removeprefix("'"))
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = _plural(w)
    if w in KEPT_AFTER_PLURAL:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _third(_second(w, r1), r1, r2)
    w = _last(_fourth(w, r2), r1, r2)
    return w.replace("Y", "y")
