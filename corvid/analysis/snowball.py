"""Stemmers of eight more languages, from the published descriptions of the Snowball algorithms.

The suffix lists are fixed values of those descriptions. A rule takes the longest of its suffixes that the word has in the
region where the rule looks; a longest suffix that fails its own condition ends the rule.
"""

from __future__ import annotations

import re
from functools import lru_cache

from corvid.analysis.stemmers import _region

ACUTE = str.maketrans("áéíóú", "aeiou")
GRAVE = str.maketrans("áéíóú", "àèìòù")


def _longest(word: str, suffixes: tuple[str, ...], start: int = 0) -> str | None:
    """The longest of the suffixes with which word[start:] ends."""
    return max((s for s in suffixes if len(word) - len(s) >= start and word.endswith(s)), key=len, default=None)


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


def _romance_region(w: str, vowels: str) -> int:
    """Where the region RV of Italian, Portuguese and Spanish begins."""
    if len(w) < 2:
        return len(w)
    if w[1] not in vowels:
        return next((k + 1 for k in range(2, len(w)) if w[k] in vowels), len(w))
    if w[0] in vowels:
        return next((k + 1 for k in range(2, len(w)) if w[k] not in vowels), len(w))
    return min(3, len(w))


def _cut(w: str, start: int, *chains: tuple[str, ...]) -> str:
    """Take off one suffix of each chain in turn, as long as each is found at or after start."""
    for chain in chains:
        s = _longest(w, chain)
        if s is None or len(w) - len(s) < start:
            break
        w = w[: -len(s)]
    return w


# --- Spanish --------------------------------------------------------------------------------------------------------

_ES_PRONOUNS = _words("me se sela selo selas selos la le lo las les los nos")
_ES_BEFORE = _words("iéndo ándo ár ér ír ando iendo ar er ir yendo")
_ES_PLAIN = _words("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos")
_ES_ACTION = _words("adora ador ación adoras adores aciones ante antes ancia ancias")
_ES_STEP1 = {
    **dict.fromkeys(_ES_PLAIN, "plain"), **dict.fromkeys(_ES_ACTION, "action"), **dict.fromkeys(_words("logía logías"), "log"), **dict.fromkeys(_words("ución uciones"), "u"),
    **dict.fromkeys(_words("encia encias"), "ente"), "amente": "amente", "mente": "mente", **dict.fromkeys(_words("idad idades"), "idad"), **dict.fromkeys(_words("iva ivo ivas ivos"), "iva"),
}
_ES_Y = _words("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_E = _words("en es éis emos")
_ES_VERBS = _words(
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)


@lru_cache(maxsize=200_000)
def spanish(word: str) -> str:
    v = "aeiouáéíóúü"
    w = word.lower()
    rv, r1 = _romance_region(w, v), _region(w, v)
    r2 = _region(w, v, r1)
    if (s := _longest(w, _ES_PRONOUNS, rv)) and (b := _longest(w[: -len(s)], _ES_BEFORE, rv)) and (b != "yendo" or w[: -len(s) - len(b)].endswith("u")):
        w = w[: -len(s)]
        if b in ("iéndo", "ándo", "ár", "ér", "ír"):
            w = w[: -len(b)] + b.translate(ACUTE)
    before, s = w, _longest(w, tuple(_ES_STEP1))
    if s:
        kind, stem = _ES_STEP1[s], w[: -len(s)]
        if len(stem) >= (r1 if kind == "amente" else r2):
            if kind in ("log", "u", "ente"):
                w = stem + kind
            elif kind == "action":
                w = _cut(stem, r2, ("ic",))
            elif kind == "amente":
                w = _cut(stem, r2, ("iv",), ("at",)) if stem.endswith("iv") else _cut(stem, r2, ("os", "ic", "ad"))
            elif kind == "mente":
                w = _cut(stem, r2, ("ante", "able", "ible"))
            elif kind == "idad":
                w = _cut(stem, r2, ("abil", "ic", "iv"))
            elif kind == "iva":
                w = _cut(stem, r2, ("at",))
            else:
                w = stem
    if w == before:
        s = _longest(w, _ES_Y, rv)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        elif s := _longest(w, _ES_E + _ES_VERBS, rv):
            w = w[: -len(s)]
            if s in _ES_E and w.endswith("gu"):
                w = w[:-1]
    s = _longest(w, _words("os a o á í ó e é"), rv)
    if s:
        w = w[: -len(s)]
        if s in "eé" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(ACUTE)


# --- Portuguese -----------------------------------------------------------------------------------------------------

_PT_PLAIN = _words(
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"
)
_PT_STEP1 = {
    **dict.fromkeys(_PT_PLAIN, "plain"), **dict.fromkeys(_words("logia logias"), "log"), **dict.fromkeys(_words("uça~o uço~es"), "u"), **dict.fromkeys(_words("ência ências"), "ente"),
    "amente": "amente", "mente": "mente", **dict.fromkeys(_words("idade idades"), "idade"), **dict.fromkeys(_words("iva ivo ivas ivos"), "iva"), **dict.fromkeys(_words("ira iras"), "ira"),
}
_PT_VERBS = _words(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)


@lru_cache(maxsize=200_000)
def portuguese(word: str) -> str:
    v = "aeiouáéíóúâêô"
    w = word.lower().replace("ã", "a~").replace("õ", "o~")
    rv, r1 = _romance_region(w, v), _region(w, v)
    r2 = _region(w, v, r1)
    before, s = w, _longest(w, tuple(_PT_STEP1))
    if s:
        kind, stem = _PT_STEP1[s], w[: -len(s)]
        if kind == "ira":
            if len(stem) >= rv and stem.endswith("e"):
                w = stem + "ir"
        elif len(stem) >= (r1 if kind == "amente" else r2):
            if kind in ("log", "u", "ente"):
                w = stem + kind
            elif kind == "amente":
                w = _cut(stem, r2, ("iv",), ("at",)) if stem.endswith("iv") else _cut(stem, r2, ("os", "ic", "ad"))
            elif kind == "mente":
                w = _cut(stem, r2, ("ante", "avel", "ível"))
            elif kind == "idade":
                w = _cut(stem, r2, ("abil", "ic", "iv"))
            elif kind == "iva":
                w = _cut(stem, r2, ("at",))
            else:
                w = stem
    if w == before and (s := _longest(w, _PT_VERBS, rv)):
        w = w[: -len(s)]
    if w != before:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    elif s := _longest(w, _words("os a i o á í ó"), rv):
        w = w[: -len(s)]
    s = _longest(w, _words("e é ê"), rv)
    if s:
        w = w[:-1]
        if (w.endswith("gu") or w.endswith("ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


# --- Italian --------------------------------------------------------------------------------------------------------

_IT_PRONOUNS = _words(
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"
)
_IT_PLAIN = _words("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti")
_IT_STEP1 = {
    **dict.fromkeys(_IT_PLAIN, "plain"), **dict.fromkeys(_words("azione azioni atore atori"), "action"), **dict.fromkeys(_words("logia logie"), "log"),
    **dict.fromkeys(_words("uzione uzioni usione usioni"), "u"), **dict.fromkeys(_words("enza enze"), "ente"), **dict.fromkeys(_words("amento amenti imento imenti"), "mento"),
    "amente": "amente", "ità": "ità", **dict.fromkeys(_words("ivo ivi iva ive"), "ivo"),
}
_IT_VERBS = _words(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


@lru_cache(maxsize=200_000)
def italian(word: str) -> str:
    v = "aeiouàèìòù"
    w = word.lower().translate(GRAVE)
    w = w.replace("qu", "qU")
    w = re.sub(f"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), w)
    rv, r1 = _romance_region(w, v), _region(w, v)
    r2 = _region(w, v, r1)
    if s := _longest(w, _IT_PRONOUNS, rv):
        stem = w[: -len(s)]
        if _longest(stem, ("ando", "endo"), rv):
            w = stem
        elif _longest(stem, ("ar", "er", "ir"), rv):
            w = stem + "e"
    before, s = w, _longest(w, tuple(_IT_STEP1))
    if s:
        kind, stem = _IT_STEP1[s], w[: -len(s)]
        if len(stem) >= {"amente": r1, "mento": rv}.get(kind, r2):
            if kind in ("log", "u", "ente"):
                w = stem + kind
            elif kind == "action":
                w = _cut(stem, r2, ("ic",))
            elif kind == "amente":
                w = _cut(stem, r2, ("iv",), ("at",)) if stem.endswith("iv") else _cut(stem, r2, ("os", "ic", "abil"))
            elif kind == "ità":
                w = _cut(stem, r2, ("abil", "ic", "iv"))
            elif kind == "ivo":
                w = _cut(stem, r2, ("at",), ("ic",))
            else:
                w = stem
    if w == before and (s := _longest(w, _IT_VERBS, rv)):
        w = w[: -len(s)]
    if len(w) - 1 >= rv and w[-1:] in set("aeioàèìò"):
        w = w[:-1]
        if len(w) - 1 >= rv and w.endswith("i"):
            w = w[:-1]
    if len(w) - 2 >= rv and w.endswith(("ch", "gh")):
        w = w[:-1]
    return w.lower()


# --- French ---------------------------------------------------------------------------------------------------------

_FR_STEP1 = {
    **dict.fromkeys(_words("ance iqUe isme able iste eux ances iqUes ismes ables istes"), "plain"), **dict.fromkeys(_words("atrice ateur ation atrices ateurs ations"), "action"),
    **dict.fromkeys(_words("logie logies"), "log"), **dict.fromkeys(_words("usion ution usions utions"), "u"), **dict.fromkeys(_words("ence ences"), "ent"), **dict.fromkeys(_words("ement ements"), "ement"),
    **dict.fromkeys(_words("ité ités"), "ité"), **dict.fromkeys(_words("if ive ifs ives"), "if"), "eaux": "eaux", "aux": "aux", **dict.fromkeys(_words("euse euses"), "euse"),
    **dict.fromkeys(_words("issement issements"), "issement"), "amment": "amment", "emment": "emment", **dict.fromkeys(_words("ment ments"), "ment"),
}
_FR_I = _words(
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
)
_FR_E = _words("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez")
_FR_A = _words("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")


def _french_suffix(w: str, v: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word after the standard suffixes, and whether verb suffixes are still looked for."""
    s = _longest(w, tuple(_FR_STEP1))
    if s is None:
        return w, True
    kind, stem = _FR_STEP1[s], w[: -len(s)]
    n = len(stem)
    if kind == "eaux":
        return stem + "eau", False
    if kind in ("amment", "emment", "ment"):
        if kind == "ment":
            return (stem if n > rv and stem[-1] in v else w), True
        return (stem + ("ant" if kind == "amment" else "ent") if n >= rv else w), True
    if kind == "aux":
        return (stem + "al", False) if n >= r1 else (w, True)
    if kind == "euse":
        return (stem, False) if n >= r2 else (stem + "eux", False) if n >= r1 else (w, True)
    if kind == "issement":
        return (stem, False) if n >= r1 and n and stem[-1] not in v else (w, True)
    if n < (rv if kind == "ement" else r2):
        return w, True
    if kind in ("log", "u", "ent"):
        return stem + kind, False
    if kind == "action" and stem.endswith("ic"):
        return (stem[:-2] if n - 2 >= r2 else stem[:-2] + "iqU"), False
    if kind == "ement":
        if stem.endswith("iv"):
            return _cut(stem, r2, ("iv",), ("at",)), False
        if stem.endswith("eus"):
            return (stem[:-3] if n - 3 >= r2 else stem[:-3] + "eux" if n - 3 >= r1 else stem), False
        if stem.endswith(("abl", "iqU")):
            return _cut(stem, r2, ("abl", "iqU")), False
        if stem.endswith(("ièr", "Ièr")) and n - 3 >= rv:
            return stem[:-3] + "i", False
    if kind == "ité":
        if stem.endswith("abil"):
            return (stem[:-4] if n - 4 >= r2 else stem[:-4] + "abl"), False
        if stem.endswith("ic"):
            return (stem[:-2] if n - 2 >= r2 else stem[:-2] + "iqU"), False
        return _cut(stem, r2, ("iv",)), False
    if kind == "if" and stem.endswith("at") and n - 2 >= r2:
        stem = stem[:-2]
        if stem.endswith("ic"):
            return (stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU"), False
    return stem, False


@lru_cache(maxsize=200_000)
def french(word: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    w = word.lower().replace("qu", "qU")
    w = re.sub(f"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), w)
    w = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", w)
    if w[:3] in ("par", "col", "tap") or (len(w) > 1 and w[0] in v and w[1] in v):
        rv = min(3, len(w))
    else:
        rv = next((k + 1 for k in range(1, len(w)) if w[k] in v), len(w))
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    before = w
    w, verbs = _french_suffix(w, v, rv, r1, r2)
    if verbs:
        s, now = _longest(w, _FR_I, rv), w
        if s and len(w) - len(s) > rv and w[-len(s) - 1] not in v:
            w = w[: -len(s)]
        if w == now:
            s = _longest(w, _FR_E + _FR_A + ("ions",), rv)
            if s == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif s:
                w = w[: -len(s)]
                if s in _FR_A and len(w) - 1 >= rv and w.endswith("e"):
                    w = w[:-1]
    if w != before:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if len(w) > 1 and w[-1] == "s" and w[-2] not in "aiouès":
            w = w[:-1]
        s = _longest(w, _words("ion ier ière Ier Ière e"), rv)
        if s == "ion":
            if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
                w = w[:-3]
        elif s:
            w = w[: -len(s)] + ("" if s == "e" else "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè](?=[^{v}]+$)", "e", w)
    return w.lower()


# --- Danish, Norwegian, Swedish -------------------------------------------------------------------------------------


def _north_region(w: str, v: str) -> int:
    return max(3, _region(w, v))


_SV = _words("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s")
_NO = _words("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast erte ert s")
_DA = _words("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s")


@lru_cache(maxsize=200_000)
def swedish(word: str) -> str:
    w = word.lower()
    r1 = _north_region(w, "aeiouyäåö")
    s = _longest(w, _SV, r1)
    if s and (s != "s" or (len(w) > 1 and w[-2] in "bcdfghjklmnoprtvy")):
        w = w[: -len(s)]
    if _longest(w, _words("dd gd nn dt gt kt tt"), r1):
        w = w[:-1]
    s = _longest(w, _words("lig ig els löst fullt"), r1)
    return w if s is None else w[:-1] if s in ("löst", "fullt") else w[: -len(s)]


@lru_cache(maxsize=200_000)
def norwegian(word: str) -> str:
    v = "aeiouyæåø"
    w = word.lower()
    r1 = _north_region(w, v)
    s = _longest(w, _NO, r1)
    if s in ("erte", "ert"):
        w = w[: -len(s)] + "er"
    elif s == "s":
        if len(w) > 1 and (w[-2] in "bcdfghjlmnoprtvyz" or (w[-2] == "k" and len(w) > 2 and w[-3] not in v)):
            w = w[:-1]
    elif s:
        w = w[: -len(s)]
    if _longest(w, ("dt", "vt"), r1):
        w = w[:-1]
    s = _longest(w, _words("leg eleg ig eig lig elig els lov elov slov hetslov"), r1)
    return w[: -len(s)] if s else w


@lru_cache(maxsize=200_000)
def danish(word: str) -> str:
    v = "aeiouyæåø"
    w = word.lower()
    r1 = _north_region(w, v)

    def pair(x: str) -> str:
        return x[:-1] if _longest(x, _words("gd dt gt kt"), r1) else x

    s = _longest(w, _DA, r1)
    if s and (s != "s" or (len(w) > 1 and w[-2] in "abcdfghjklmnoprtvyzå")):
        w = w[: -len(s)]
    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    s = _longest(w, _words("ig lig elig els løst"), r1)
    if s:
        w = w[:-1] if s == "løst" else pair(w[: -len(s)])
    return w[:-1] if len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in v else w


# --- Russian --------------------------------------------------------------------------------------------------------

#: Suffixes that stand only behind а or я, and suffixes that stand alone.
_RU_GERUND = (_words("в вши вшись"), _words("ив ивши ившись ыв ывши ывшись"))
_RU_ADJECTIVE = _words("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_PARTICIPLE = (_words("ем нн вш ющ щ"), _words("ивш ывш ующ"))
_RU_VERB = (
    _words("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"),
    _words("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"),
)
_RU_NOUN = _words("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


@lru_cache(maxsize=200_000)
def russian(word: str) -> str:
    v = "аеиоуыэюя"
    w = word.lower().replace("ё", "е")
    rv = next((k + 1 for k, c in enumerate(w) if c in v), len(w))
    r2 = _region(w, v, _region(w, v))

    def grouped(x: str, groups) -> str:
        s = _longest(x, groups[0] + groups[1], rv)
        if s is None or (s in groups[0] and s not in groups[1] and not (len(x) - len(s) > rv and x[-len(s) - 1] in "ая")):
            return x
        return x[: -len(s)]

    cut = grouped(w, _RU_GERUND)
    if cut == w:
        if s := _longest(w, ("ся", "сь"), rv):
            w = w[: -len(s)]
        if s := _longest(w, _RU_ADJECTIVE, rv):
            w = grouped(w[: -len(s)], _RU_PARTICIPLE)
        elif (cut := grouped(w, _RU_VERB)) != w:
            w = cut
        elif s := _longest(w, _RU_NOUN, rv):
            w = w[: -len(s)]
    else:
        w = cut
    if len(w) - 1 >= rv and w.endswith("и"):
        w = w[:-1]
    if s := _longest(w, ("ост", "ость"), max(rv, r2)):
        w = w[: -len(s)]
    if s := _longest(w, ("ейш", "ейше"), rv):
        w = w[: -len(s)]
        return w[:-1] if w.endswith("нн") and len(w) - 1 >= rv else w
    if (w.endswith("нн") or w.endswith("ь")) and len(w) - 1 >= rv:
        w = w[:-1]
    return w


STEMMERS = {f.__name__: f for f in (danish, french, italian, norwegian, portuguese, russian, spanish, swedish)}
