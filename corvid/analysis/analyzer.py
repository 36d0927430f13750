"""One analysis pipeline for documents and queries: (id, text) -> (id, terms)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.analysis import normalize as n
from corvid.analysis.sentences import SentenceModel
from corvid.analysis.stemmers import get_stemmer, stem_batches
from corvid.analysis.stopwords import get_stopwords


def resolve_tokenizer(given: str | Callable | None) -> Callable[[Column], Column] | None:
    """A name, a Python function from string to list of strings, a trained sentence splitter, or None (the column holds tokens already)."""
    if given is None:
        return None
    if isinstance(given, SentenceModel):
        return given.split
    if callable(given):
        @F.pandas_udf("array<string>")
        def tokens(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else list(given(t)))

        return tokens
    if given.lower() not in n.TOKENIZERS:
        raise NotImplementedError(f"tokenizer {given!r} is not supported")
    return n.TOKENIZERS[given.lower()]


@dataclass(frozen=True)
class Analyzer:
    tokenizer: str | Callable | SentenceModel | None = "whitespace"
    stemmer: str | Callable | None = None
    stopwords: str | Iterable[str] | None = None
    do_lowercasing: bool = True
    do_ampersand_normalization: bool = True
    do_special_chars_normalization: bool = True
    do_acronyms_normalization: bool = True
    do_punctuation_removal: bool = True
    do_diacritics_normalization: bool = False
    _stops: frozenset = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        stemmer, words = get_stemmer(self.stemmer), get_stopwords(self.stopwords)
        resolve_tokenizer(self.tokenizer)
        # stop words are stemmed once, and compared with tokens that are not
        object.__setattr__(self, "_stops", frozenset(stemmer(w) for w in words) if stemmer else words)

    def _split(self, c: Column) -> Column:
        """Tokens, stop words included, as an array column."""
        steps = [
            (self.do_lowercasing, n.lowercase), (self.do_ampersand_normalization, n.ampersand), (self.do_special_chars_normalization, n.special_chars),
            (self.do_acronyms_normalization, n.acronyms), (self.do_diacritics_normalization, n.diacritics),
        ]
        split = resolve_tokenizer(self.tokenizer)
        if split is not None:
            for on, step in steps:
                c = step(c) if on else c
            if self.tokenizer == "whitespace":
                c = n.whitespace_and_punctuation(c) if self.do_punctuation_removal else split(c)
            else:
                c = split(c)
                if self.do_punctuation_removal:
                    c = F.filter(F.transform(c, n.punctuation), lambda t: t != "")
        return c

    def tokens(self, c: Column) -> Column:
        """Terms before stemming, as an array column."""
        c = self._split(c)
        if self._stops:
            stops = F.array(*(F.lit(w) for w in sorted(self._stops)))
            c = F.filter(c, lambda t: ~F.array_contains(stops, t))
        return c

    @property
    def stops(self) -> frozenset[str]:
        """The words that are dropped: compared with tokens that are not stemmed, but stemmed themselves."""
        return self._stops

    def words(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, term) with one row per occurrence, before stemming."""
        rows = texts.select(F.col(id_col), F.explode(self._split(F.col(text_col))).alias("term"))
        # looked up in a hash set, where an array would be searched word by word
        return rows.where(~F.col("term").isin(sorted(self._stops))) if self._stops else rows

    def stems(self, vocabulary: DataFrame) -> DataFrame:
        """(term, stem) of distinct terms. They are few bytes but much work, so they are dealt to all cores and not by size."""
        spread = vocabulary.repartition(vocabulary.sparkSession.sparkContext.defaultParallelism, "term")
        return spread.mapInPandas(stem_batches(get_stemmer(self.stemmer)), "term string, stem string")

    def terms(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, term) with one row per occurrence, in one pass and without an exchange: for queries. Large tables are counted
        before they are stemmed (`stems`)."""
        stemmer, tokens = get_stemmer(self.stemmer), self.tokens(F.col(text_col))
        if stemmer is not None:
            tokens = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else [stemmer(x) for x in t]), "array<string>")(tokens)
        return texts.select(F.col(id_col), F.explode(tokens).alias("term"))
