"""Substring dedup by level-wise doubling.

Level lengths double from `seed_words` up to `min_words` (the last step is cut to end there; a window of w
words is covered by two halves that overlap). At a level of length w each still living window of `min_words`
words stands for itself by its smallest-hashed w-word part. A window lives on only if that part is repeated in
another document: equal windows choose equal parts, so no repeat is lost, and a level whose survivors are none
ends the work. Only the parts travel, never the text of all windows; the last level compares 96-bit hashes of
the full windows that are left.

Defined cases: null and empty texts have no words; texts under `min_words` words keep all; rows that repeat a
doc_id are answered one by one and never count as each other's earlier copy; a null doc_id is kept whole; ties
cannot arise, since only a smaller doc_id removes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import as_long, by_batches, dealt_text, grams, keyed_text, pieces, sliding_min, utf8, word_hashes

SEED_WORDS = 7
MIN_WORDS = 13


def level_lengths(seed: int, target: int) -> list[int]:
    out = [min(seed, target)]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out


def _parts(words: np.ndarray, doc: np.ndarray, length: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `target` words inside one text: its start, and the hash of its chosen part."""
    starts = np.flatnonzero(doc[: len(doc) - target + 1] == doc[target - 1 :]) if len(doc) >= target else np.empty(0, np.int64)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    return starts, sliding_min(grams(words, length), target - length + 1)[starts]


def _known(doc: np.ndarray, values: np.ndarray, lists: list) -> np.ndarray:
    """Which values are in the list of their own text; doc ascends."""
    out = np.zeros(len(values), bool)
    edges = np.searchsorted(doc, np.arange(len(lists) + 1))
    for k, hits in enumerate(lists):
        if hits is not None and len(hits) and edges[k] < edges[k + 1]:
            out[edges[k] : edges[k + 1]] = np.isin(values[edges[k] : edges[k + 1]], np.asarray(hits, np.int64).view(np.uint64))
    return out


def _hits(batch) -> list:
    column = batch.column("hits")
    return [None if not x.is_valid else x.values.to_numpy() for x in column]


def _emit(length: int, before: int | None, target: int):
    def run(batches):
        for batch in pieces(batches):
            words, counts = word_hashes(utf8(batch.column("text")))
            doc = np.repeat(np.arange(len(counts)), counts)
            ids = batch.column("doc_id").to_numpy()
            starts, part = _parts(words, doc, length, target)
            if before and len(starts):
                live = _known(doc[starts], _parts(words, doc, before, target)[1], _hits(batch))
                starts, part = starts[live], part[live]
            if not len(starts):
                continue
            owner = doc[starts]
            second = (grams(words, length, 1)[starts] if length == target else np.zeros(len(part), np.uint64)).astype(np.uint32).view(np.int32)
            # a text says each part once, also where it holds it again and again
            order = np.lexsort((part, owner))
            first = np.ones(len(order), bool)
            first[1:] = (part[order][1:] != part[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            pick = order[first]
            yield pa.RecordBatch.from_arrays([as_long(part[pick]), pa.array(second[pick]), pa.array(ids[owner[pick]])], ["k1", "k2", "doc_id"])

    return run


def _settle(rows: DataFrame, last: bool) -> DataFrame:
    """(key, hits): the parts of each document that another document has too (last: a smaller one)."""
    same = Window.partitionBy("k1", "k2")  # the parts travel once; a join of them with their counts would deal them twice
    seen = rows.select("*", F.min("doc_id").over(same).alias("lo"), F.max("doc_id").over(same).alias("hi"))
    hits = seen.where("doc_id > lo" if last else "lo < hi")
    return hits.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("k1").alias("hits"))


def _answer(target: int, full: bool, rest: bool = False):
    def run(batches):
        for batch in pieces(batches):
            texts = utf8(batch.column("text"))
            hits = _hits(batch)
            out = []
            for t, h in zip(texts, hits):
                split = t.split()
                gone = np.zeros(len(split), bool)
                if h is not None and len(split) >= target:
                    words, _ = word_hashes([t])
                    dup = np.isin(grams(words, target), h.view(np.uint64))
                    edge = np.zeros(len(split) + 1, np.int64)
                    at = np.flatnonzero(dup)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + target, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join(compress(split, ~gone) if gone.any() else split)
                out.append((len(split), int(gone.sum()), kept))
            n, r, k = zip(*out)
            last = pa.array([x.decode() for x in k]) if full else pa.array([hashlib.sha256(x).hexdigest() for x in k])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), last]
            names = ["doc_id", "n_words", "n_removed", "kept"]
            if rest:  # whole documents go on: an untouched text to the letter, a null one as null
                untouched = pa.array([not x for x in r], pa.bool_())
                columns[3] = pc.if_else(untouched, batch.column("text"), last)
                columns, names = [*columns, batch.column("rest")], [*names, "rest"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


_COUNTS = "doc_id long, n_words long, n_removed long, kept string"


def _repeats(docs: DataFrame, dealt: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """(key, hits): the hashes of each document's windows that a document with a smaller id has too."""
    before, hits = None, None
    for length in level_lengths(seed_words, min_words):
        source = keyed_text(docs).where("doc_id is not null") if hits is None else dealt.join(hits, "key")
        rows = source.transform(by_batches, _emit(length, before, min_words), "k1 long, k2 int, doc_id long")
        hits, before = _settle(rows, length == min_words), length
    return hits


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, or their SHA-256)."""
    dealt = dealt_text(docs)
    hits = _repeats(docs, dealt, min_words, seed_words)
    return dealt.join(hits, "key", "left").transform(by_batches, _answer(min_words, not digest), _COUNTS)


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """The documents with what stays of their texts, all columns; n_chars, where there is one, follows.

    A text that loses nothing is unchanged to the letter; one that loses words has the rest joined by one blank. A text
    of which nothing stays is empty. Rows that repeat a doc_id are cut one by one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    dealt = dealt_text(docs, others)
    hits = _repeats(docs, dealt, min_words, seed_words)
    kind = f", rest {dealt.schema['rest'].dataType.simpleString()}" if others else ""
    cut = dealt.join(hits, "key", "left").transform(by_batches, _answer(min_words, True, bool(others)), _COUNTS + kind)

    def column(name: str):
        if name == "doc_id":
            return F.col("doc_id")
        if name == "text":
            return F.col("kept")
        was = F.col(f"rest.c{others.index(name)}")
        return F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(was) if name == "n_chars" else was

    return cut.select([column(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
