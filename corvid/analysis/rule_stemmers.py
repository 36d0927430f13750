"""Stemmers that are tables of rules, run by one interpreter."""

from __future__ import annotations

import re
from functools import lru_cache

# The published Paice/Husk rules. An ending backwards, * if the word must be untouched, how many letters
# go, what comes in their place, and whether to go on (>) or stop (.); the first rule that fits is taken.
LANCASTER = """
ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1.
ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3.
lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0.
ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0.
tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j>
vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3>
zi2> zy1s.
"""


def _table(rules: str) -> dict[str, list[tuple[str, bool, int, str, bool]]]:
    """Rules by the last letter of their ending: (ending, untouched, letters that go, replacement, go on)."""
    out: dict[str, list] = {}
    for backwards, star, cut, add, end in re.findall(r"([a-z]+)(\*?)(\d)([a-z]*)([.>])", rules):
        out.setdefault(backwards[0], []).append((backwards[::-1], bool(star), int(cut), add, end == ">"))
    return out


_LANCASTER = _table(LANCASTER)
#: What a rule must leave: two letters after a vowel at the start, else three with a vowel in the second or third place.
_STARTS_WITH_VOWEL, _VOWEL_SOON = re.compile("[aeiouy]"), re.compile(".{1,2}?[aeiouy]", re.S)


@lru_cache(maxsize=200_000)
def lancaster(word: str) -> str:
    """Iterated rules of Paice and Husk. A word of other letters at its end stays, in lower case."""
    w = given = word.lower()
    going = True
    while going:
        going = False
        least = 2 if _STARTS_WITH_VOWEL.match(w) else 3 if _VOWEL_SOON.match(w) else len(w) + 1
        for ending, untouched, cut, add, again in _LANCASTER.get(w[-1:], ()):
            if w.endswith(ending) and len(w) - cut >= least and (not untouched or w == given):
                w, going = w[: len(w) - cut] + add, again
                break
    return w
