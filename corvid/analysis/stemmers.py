"""Stemmers, from the published descriptions of the Snowball algorithms; further ones can be registered.

Stemming is a function of the word alone, so each distinct term is stemmed once (`Analyzer.stems`) and joined back.
English, Porter, German and Cistem are here, eight more languages in `snowball`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

Stemmer = Callable[[str], str]

#: Fixed values of the English algorithm: whole words with stems of their own, and words to leave alone.
ENGLISH_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
ENGLISH_LEFT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
    ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    for k in range(start + 1, len(word)):
        if word[k] not in vowels and word[k - 1] in vowels:
            return k + 1
    return len(word)


def _short_end(w: str, v: str = "aeiouy") -> bool:
    if len(w) == 2:
        return w[0] in v and w[1] not in v
    return len(w) > 2 and w[-3] not in v and w[-2] in v and w[-1] not in v and w[-1] not in "wxY"


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    v = "aeiouy"
    w = word.lower().translate({0x2019: "'", 0x2018: "'", 0x201B: "'"})
    if len(w) <= 2:
        return w
    if w in ENGLISH_EXCEPTIONS:
        return ENGLISH_EXCEPTIONS[w]
    w = w.removeprefix("'")
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", w)
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _region(w, v)
    r2 = _region(w, v, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in v for c in w[:-2]):
        w = w[:-1]
    if w in ENGLISH_LEFT:
        return w.lower()
    for s in ("eedly", "eed"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                stem = w[: -len(s)]
                if any(c in v for c in stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif s == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(s)] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@lru_cache(maxsize=200_000)
def german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.lower().replace("ß", "ss")
    w = re.sub(rf"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), w)
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    r1 = max(3, r1)
    for s in ("ern", "em", "er", "en", "es", "e", "s"):
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
                w = w[: -len(s)]
                if s in ("e", "en", "es") and w.endswith("niss"):
                    w = w[:-1]
            break
    for s in ("est", "en", "er", "st"):
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "st" or (w[-3:-2] in tuple("bdfghklmnt") and len(w) > 5)):
                w = w[: -len(s)]
            break
    for s in ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"):
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                if s in ("end", "ung"):
                    w = w[: -len(s)]
                    if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e":
                        w = w[:-2]
                elif s in ("ig", "ik", "isch"):
                    w = w[: -len(s)] if w[: -len(s)][-1:] != "e" else w
                else:
                    w = w[: -len(s)]
                    for t in ("er", "en") if s in ("lich", "heit") else ("lich", "ig"):
                        if w.endswith(t):
                            if len(w) - len(t) >= (r1 if s in ("lich", "heit") else r2):
                                w = w[: -len(t)]
                            break
            break
    return w.translate(str.maketrans("äöüUY", "aouuy"))


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The original English algorithm of 1980."""
    w = word.lower()
    if len(w) <= 2:
        return w

    def consonant(s: str, i: int) -> bool:
        return s[i] not in "aeiou" and not (s[i] == "y" and i > 0 and consonant(s, i - 1))

    def measure(s: str) -> int:
        form = "".join("c" if consonant(s, i) else "v" for i in range(len(s)))
        return len(re.findall(r"v+c+", form))

    vowel = lambda s: any(not consonant(s, i) for i in range(len(s)))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and consonant(s, len(s) - 1)
    cvc = lambda s: len(s) > 2 and consonant(s, len(s) - 3) and not consonant(s, len(s) - 2) and consonant(s, len(s) - 1) and s[-1] not in "wxy"
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    second = [(s, to) for s, to in _STEP2 if s not in ("lessli", "fulli", "li", "ogi", "bli")] + [("eli", "e")]
    for pairs in (second, [(s, to) for s, to in _STEP3 if s not in ("ational", "tional")]):
        for s, to in sorted(pairs, key=lambda p: -len(p[0])):
            if w.endswith(s):
                w = w[: -len(s)] + to if measure(w[: -len(s)]) > 0 else w
                break
    for s in sorted([*_STEP4, "ou"], key=len, reverse=True):
        if s != "ous" and s == "ou" and w.endswith("ous"):
            continue
        if w.endswith(s):
            if measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=200_000)
def cistem(word: str) -> str:
    """The published German segment stripper."""
    w = word.lower().translate(str.maketrans({"ü": "u", "ö": "o", "ä": "a", "ß": "ss"}))
    if len(w) > 6:
        w = re.sub(r"^ge(?=.{4})", "", w)
    w = re.sub(r"(.)\1", r"\1*", w.replace("sch", "$").replace("ei", "%").replace("ie", "&"))
    while len(w) > 3:
        if len(w) > 5 and (n := re.sub(r"e[mr]$|nd$", "", w)) != w:
            w = n
        elif not word[:1].isupper() and (n := re.sub(r"t$", "", w)) != w:
            w = n
        elif (n := re.sub(r"[esn]$", "", w)) != w:
            w = n
        else:
            break
    return re.sub(r"(.)\*", r"\1\1", w).replace("&", "ie").replace("%", "ei").replace("$", "sch")


STEMMERS: dict[str, Stemmer] = {"english": english, "porter": porter, "german": german, "cistem": cistem}
#: Names whose algorithms or dictionaries are not written here: register one before use.
OPEN = (
    "krovetz arlstem arlstem2 isri arabic basque catalan dutch finnish greek hindi hungarian indonesian irish lithuanian nepali romanian tamil turkish"
).split()


def register_stemmer(name: str, stemmer: Stemmer) -> None:
    STEMMERS[name.lower()] = stemmer


def get_stemmer(given: str | Stemmer | None) -> Stemmer | None:
    if given is None or callable(given):
        return given
    from corvid.analysis import rule_stemmers, snowball

    name = given.lower()
    if name in STEMMERS:
        return STEMMERS[name]
    if name == "lancaster":
        return rule_stemmers.lancaster
    if name in snowball.STEMMERS:
        return snowball.STEMMERS[name]
    hint = f"; use register_stemmer({name!r}, function)" if name in OPEN else ""
    raise NotImplementedError(f"stemmer {given!r} is not available{hint}")


def stem_batches(stemmer: Stemmer):
    """For mapInPandas over (term): (term, stem)."""

    def run(frames: Iterator) -> Iterator:
        for f in frames:
            yield f.assign(stem=[stemmer(t) for t in f["term"]])

    return run
