"""Token counts with overlap resynchronisation for huge documents.

A text of up to `chunk` characters is counted as the sum over its blank-separated stretches: no pre-token of this
kind of vocabulary spans white space, so the library encodes each distinct stretch of up to `WORD` characters once per
task and the counts are remembered (at most `MEMORY` of them); longer stretches are counted where they stand. A longer text is encoded in chunks that overlap; where two
chunks overlap, they are spliced at a boundary that both prove: a blank or line break (no pre-token of this kind of
vocabulary spans white space), with equal tokens at equal offsets on the way to the next such place. If a chunk's
overlap holds no such boundary, the overlap is doubled and the chunk encoded anew, at worst up to the end.

Defined cases: null and empty texts have no bytes and no tokens; rows that repeat a doc_id, or have none, are
answered one by one; other columns are not read; no text is cut.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from corvid.llm.common import by_batches, keyed_text, pieces

CHUNK = 1 << 16
OVERLAP = 512
TOKEN_LIMIT = 2048
MEMORY = 400_000
WORD = 32
VOCABULARY = "word_bpe_49k.json"

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of this file, once per process."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def spliced_count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of text, as tok.encode(text) gives them."""
    if len(text) <= chunk:
        return len(tok.encode(text, add_special_tokens=False).ids)
    starts = list(range(0, len(text), chunk))
    if len(starts) > 1 and len(text) - starts[-1] <= overlap:
        starts.pop()
    total, begin, at = 0, 0, 0  # begin: where counting goes on, a proven boundary in the chunk from `at`
    current = None
    k = 0
    while True:
        wide = overlap
        nxt = starts[k + 1] if k + 1 < len(starts) else None
        while True:
            end = len(text) if nxt is None else min(len(text), nxt + wide)
            current = _tokens(tok, text, at, end)
            if end == len(text):
                return total + sum(1 for _, s, _ in current if s >= begin)
            following = _tokens(tok, text, nxt, end)
            cut = _boundary(text, nxt, end, current, following)
            if cut is not None:
                break
            wide *= 2
        total += sum(1 for _, s, _ in current if begin <= s < cut)
        begin, at = cut, nxt
        k += 1


def _tokens(tok, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
    e = tok.encode(text[a:b], add_special_tokens=False)
    return [(i, a + s, a + t) for i, (s, t) in zip(e.ids, e.offsets)]


def _boundary(text: str, lo: int, hi: int, left: list, right: list) -> int | None:
    """The first blank in [lo, hi) from which on both chunks give the same tokens up to the last blank there."""
    blanks = [p for p in range(lo, hi) if text[p] in " \n"]
    if len(blanks) < 2:
        return None
    first, last = blanks[0], blanks[-1]
    a = [x for x in left if x[1] >= first and x[2] <= last]
    b = [x for x in right if x[1] >= first and x[2] <= last]
    crossing = any(s < first < t for _, s, t in left) or any(s < first < t for _, s, t in right)
    return first if a and a == b and not crossing else None


def _lengths(tok, stretches: list[str]) -> list[int]:
    return [len(e.ids) for a in range(0, len(stretches), 10_000) for e in tok.encode_batch_fast(stretches[a : a + 10_000], add_special_tokens=False)]


def _remembered(tok, texts: list[str], known: dict[str, int]) -> list[int]:
    split = [t.replace("\n", " ").split(" ") for t in texts]
    if len(known) > MEMORY:
        known.clear()
    new = list(set().union(*split).difference(known))
    known.update(zip(new, _lengths(tok, new)))
    out = [sum(map(known.__getitem__, words)) for words in split]
    for w in new:
        if len(w) > WORD:
            del known[w]
    return out


def _count(path: str, chunk: int, limit: int):
    def run(batches):
        tok, known = tokenizer(path), {}
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            short = [t for t in texts if len(t) <= chunk]
            counts = iter(_remembered(tok, short, known))
            n = [next(counts) if len(t) <= chunk else spliced_count(tok, t, chunk) for t in texts]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. `path`: the vocabulary, on every executor."""
    return keyed_text(docs).transform(by_batches, _count(path, chunk, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
