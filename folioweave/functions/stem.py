"""Porter's stemming algorithm, with the customary extensions for short words (published rules; fixed values below)."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

# Words with stems of their own, and each step's endings.
OWN = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c or v for each letter; y after a consonant is a vowel."""
    out = ""
    for k, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and k and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant but w, x, y; or is a vowel and a consonant."""
    s = _shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def _first(word: str, endings: dict[str, str], holds: Callable[[str], bool]) -> str:
    """The first ending that the word has is replaced, if the condition holds of what stands before it."""
    for ending, new in endings.items():
        if word.endswith(ending):
            rest = word[: len(word) - len(ending)]
            return rest + new if holds(rest) else word
    return word


def _past(word: str) -> str:
    """-ied, -eed, -ed and -ing."""
    if word.endswith("ied"):
        return word[:-3] + ("ie" if len(word) == 4 else "i")
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    rest = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
    if rest is None:
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _double(rest):
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if measure(rest) == 1 and _short(rest) else rest


def _second(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]) > 0:
        return _second(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    return _first(word, STEP2, lambda rest: measure(rest) > 0)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if word in OWN or len(word) <= 2:
        return OWN.get(word, word)
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    else:
        word = _first(word, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, lambda rest: True)
    word = _past(word)
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _first(_second(word), STEP3, lambda rest: measure(rest) > 0)
    for ending in STEP4:
        if word.endswith(ending):
            rest = word[: -len(ending)]
            if measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word
