"""Stop-word lists: Spark ships 14 languages; further ones can be registered."""

from __future__ import annotations

from collections.abc import Iterable

SHIPPED = ("danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian", "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish")
#: Languages whose lists are not public in this environment: register them before use.
OPEN = ("arabic", "azerbaijani", "basque", "bengali", "catalan", "chinese", "greek", "hebrew", "hinglish", "indonesian", "kazakh", "nepali", "romanian", "slovene", "tajik")

_REGISTERED: dict[str, frozenset[str]] = {}


def register_stopwords(language: str, words: Iterable[str]) -> None:
    _REGISTERED[language.lower()] = frozenset(words)


def get_stopwords(given: str | Iterable[str] | None) -> frozenset[str]:
    """The set for a language name, a collection of words, or None."""
    if given is None:
        return frozenset()
    if not isinstance(given, str):
        return frozenset(given)
    name = given.lower()
    if name in _REGISTERED:
        return _REGISTERED[name]
    if name in SHIPPED:
        from pyspark.ml.feature import StopWordsRemover

        return frozenset(StopWordsRemover.loadDefaultStopWords(name))
    if name in OPEN:
        raise NotImplementedError(f"no stop-word list for {name!r} is shipped; use register_stopwords({name!r}, words)")
    raise NotImplementedError(f"stop words for {given!r} are not supported")
