"""Text normalisation and tokenisation as Column expressions; all of it stays in generated code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic quotes and dashes with their plain forms, and the ASCII punctuation marks.
TYPOGRAPHIC = "‘’´“”–-"
PLAIN = "'''\"\"--"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A full stop that ends no number and no dotted name.
ACRONYM = r"(?U)\.(?!(\S[^. ])|\d)"


def lowercase(c: Column) -> Column:
    return F.lower(c)


def ampersand(c: Column) -> Column:
    return F.replace(c, F.lit("&"), F.lit(" and "))


def special_chars(c: Column) -> Column:
    for mark, plain in zip(TYPOGRAPHIC, PLAIN):
        if mark != plain:
            c = F.replace(c, F.lit(mark), F.lit(plain))  # searches bytes; translate looks up every character
    return c


def acronyms(c: Column) -> Column:
    return F.regexp_replace(c, ACRONYM, "")


def punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, " " * len(PUNCTUATION))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), " {2,}", " ")


#: Latin letters for letters that no decomposition leads to, small ones; capitals follow them.
LATIN = dict(zip("øđłħŧı", "odlhti")) | {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"}
GREEK = dict(zip("αβγδεζηικλμνοπρσςτυω", "abgdezeiklmnoprsstuo")) | {"θ": "th", "ξ": "x", "φ": "ph", "χ": "kh", "ψ": "ps"}
CYRILLIC = dict(zip("абвгдезиклмнопрстуфыэіј", "abvgdeziklmnoprstufyeij")) | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ъ": "", "ь": "", "є": "ie", "ђ": "dj", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz"}


def transliterate(c: Column) -> Column:
    """Letters of other alphabets in Latin ones, by built-in expressions: single letters at once, the others one by one."""
    table = {x: y for small in (LATIN, GREEK, CYRILLIC) for x, y in small.items()}
    table |= {x.upper(): y.capitalize() for x, y in table.items() if len(x.upper()) == 1 and x.upper() != y.upper()} | {"ẞ": "SS"}
    single = {x: y for x, y in table.items() if len(y) < 2}
    last = sorted(single, key=lambda x: not single[x])  # those that go stand behind those that have a partner
    c = F.translate(c, "".join(last), "".join(single[x] for x in last))
    for x, y in table.items():
        if len(y) > 1:
            c = F.replace(c, F.lit(x), F.lit(y))
    return c


def diacritics(c: Column) -> Column:
    """Letters without their marks, in Latin letters: compatibility decomposition with combining marks dropped (needs Python), then `transliterate`."""
    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)

    return transliterate(strip(c))


def whitespace(c: Column) -> Column:
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def whitespace_and_punctuation(c: Column) -> Column:
    """What `whitespace` gives after `punctuation`, in one pass."""
    return F.array_remove(F.split(c, r"(?U)[\s!-/:-@\[-`{-~]+"), "")


def wordpunct(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)(\w+|[^\w\s]+)"), F.lit(1))


def word(c: Column) -> Column:
    """Treebank-style words: punctuation apart, contractions split before their apostrophe.

    An approximation by public rules; abbreviation handling of trained sentence splitters is not reproduced.
    """
    c = F.regexp_replace(c, r"(?U)(\.\.\.|[;@#$%&?!,:()\[\]{}<>\"]|--)", r" $1 ")
    c = F.regexp_replace(c, r"(?U)([^.\s])(\.)([\])}>\"']*)\s*$", r"$1 $2$3 ")
    c = F.regexp_replace(c, r"(?Ui)([^' ])('s|'m|'d|'ll|'re|'ve|n't)(?=\s|$)", r"$1 $2")
    return whitespace(c)


def sent(c: Column) -> Column:
    """Sentences as tokens: split after end marks before white space; `sentences.SentenceModel` learns what is no end."""
    return F.filter(F.split(c, r"(?U)(?<=[.!?])\s+"), lambda t: t != "")


TOKENIZERS = {"whitespace": whitespace, "word": word, "wordpunct": wordpunct, "sent": sent}
