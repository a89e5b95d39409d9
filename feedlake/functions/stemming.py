"""English stems by the published Porter2 rules, as text-search engines make them."""

from __future__ import annotations

import re

#: Words with stems of their own, and words that stay or stop early: fixed values of the rules.
OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
DONE_EARLY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what takes their place: in the region after the first vowel and consonant, then again, then (deleted) further on.
ENDINGS_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
ENDINGS_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
ENDINGS_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in OWN_STEMS:
        return OWN_STEMS[word]
    if word in UNCHANGED:
        return word
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    begun = re.match("gener|commun|arsen", w)
    m = begun or _REGION.search(w)
    one = m.end() if m else len(w)
    m = _REGION.search(w, one)
    two = m.end() if m else len(w)
    in_one = lambda end: len(w) - len(end) >= one
    in_two = lambda end: len(w) - len(end) >= two

    w = re.sub(r"'(s'?)?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in DONE_EARLY:
        return w

    if end := next((e for e in ("eedly", "eed") if w.endswith(e)), None):
        w = w[: -len(end)] + "ee" if in_one(end) else w
    elif (end := next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)) and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")) or (not _DOUBLE.search(w) and len(w) <= one and _SHORT_END.search(w)):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
    w = re.sub(r"(?<=.)(?<![aeiouy])[yY]$", "i", w) if len(w) > 2 else w

    if end := next((e for e in ENDINGS_2 if w.endswith(e)), None):
        fits = w[-4:-3] == "l" if end == "ogi" else w[-3:-2] in set("cdeghkmnrt") if end == "li" else True
        w = w[: -len(end)] + ENDINGS_2[end] if in_one(end) and fits else w
    if end := next((e for e in ENDINGS_3 if w.endswith(e)), None):
        w = w[: -len(end)] + ENDINGS_3[end] if (in_two(end) if end == "ative" else in_one(end)) else w
    if end := next((e for e in ENDINGS_4 if w.endswith(e)), None):
        w = w[: -len(end)] if in_two(end) and (end != "ion" or w[-4:-3] in ("s", "t")) else w
    if w.endswith("e") and (in_two("e") or (in_one("e") and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and in_two("l"):
        w = w[:-1]
    return w.lower()
