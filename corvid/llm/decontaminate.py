"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased words joined by blanks. An item of m characters may differ by k = m // `CHARACTERS_PER_ERROR`
edits. Cut into k + 1 pieces, at least one piece is then untouched, so exact hits of pieces (one automaton for the pieces of a block
of items, one pass over each text) give every place to look at; there Myers' bit-parallel distance decides.

Items go to the tasks in blocks of at most `BLOCK_CHARS` characters (a single longer item is a block). One block is one pass
over the texts, where they are, and nothing is exchanged. A larger benchmark means a pass for each block: its finds are
written to the shared folder before the next block is fetched, so neither the driver nor a task ever holds two, and documents
to drop are then told by two 64-bit hashes of their texts.

Defined cases: null and empty texts hold nothing; items without a word are skipped; an item shorter than one error's
worth must be there exactly, at word bounds; rows that repeat a doc_id are scanned one by one; equal items all match;
of several matches of an item in a text that with the least distance counts, then the first; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import by_batches, keyed_text, pieces, stash

CHARACTERS_PER_ERROR = 12
BLOCK_CHARS = 4 << 20
_WORD = re.compile(r"\w+")

Item = tuple[int, str]


def normal(text: str) -> str:
    """Words of the lower-cased text between blanks, with a blank at each end."""
    return f" {' '.join(_WORD.findall(text.lower()))} "


def myers(pattern_masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int]:
    """(least distance of the pattern to any substring of text, end of the first such), over k: (k + 1, -1)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = k + 1, -1
    for j, c in enumerate(text):
        eq = pattern_masks.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | x) & full
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        if score < best:
            best, at = score, j + 1
        up, down = (up << 1) & full, (down << 1) & full  # a match may start anywhere
        plus, minus = down | (full & ~(x | up)), up & x
    return best, at


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[Item], per_error: int):
        self.items = [(i, t, len(t.strip()) // per_error) for i, t in ((i, normal(t)) for i, t in items) if t.strip()]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            cuts = [len(t) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                where.setdefault(t[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def _masks(self, n: int) -> dict[str, int]:
        if n not in self.masks:
            masks: dict[str, int] = {}
            for p, c in enumerate(self.items[n][1]):
                masks[c] = masks.get(c, 0) | 1 << p
            self.masks[n] = masks
        return self.masks[n]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) for each item in the text; places count characters of its normal form."""
        if not self.items or not text:
            return []
        body = normal(text)
        looks: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(body):
            for n, a in places:
                looks.setdefault(n, []).append(end + 1 - size - a)
        out = []
        for n, starts in looks.items():
            item, t, k = self.items[n]
            best = (k + 1, 0, 0)
            seen_to = -1
            for s in sorted(set(starts)):
                if body.startswith(t, max(0, s)):
                    best = (0, max(0, s), max(0, s) + len(t))
                    break
                lo, hi = max(0, s - k), min(len(body), s + len(t) + k)
                if hi <= seen_to:
                    continue
                # neighbouring places are looked at together
                hi = min(len(body), hi + len(t))
                seen_to = hi
                d, end = myers(self._masks(n), len(t), body[lo:hi], k)
                if d < best[0]:
                    best = (d, max(0, lo + end - len(t)), lo + end)
            if best[0] <= k:
                out.append((item, *best))
        return out


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """The items in blocks of at most `limit` characters (a single longer item is a block)."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        if block and size + len(row.text) > limit:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block:
        yield block


def _hits(items: list[Item], per_error: int):
    def run(batches):
        matcher = Matcher(items, per_error)
        for batch in pieces(batches):
            rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for hit in matcher.find(t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "distance", "start", "end"])

    return run


_HIT = "doc_id long, item_id long, distance long, start long, end long"


def matches(docs: DataFrame, benchmark: DataFrame, per_error: int = CHARACTERS_PER_ERROR, limit: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, start, end."""
    out = _by_blocks(benchmark, limit, lambda block: keyed_text(docs).transform(by_batches, _hits(block, per_error), _HIT))
    return docs.sparkSession.createDataFrame([], _HIT) if out is None else out


def _by_blocks(benchmark: DataFrame, limit: int, scan) -> DataFrame | None:
    """What scan(block) finds, over all blocks: a plan if there is one block, else written tables."""
    blocks = item_blocks(benchmark, limit)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return None
    out = scan(first)
    if second is not None:
        out = stash(out, "found")
        for block in chain([second], blocks):
            out = out.union(stash(scan(block), "found"))
    return out


def _verdicts(items: list[Item], per_error: int, keep: bool):
    """The rows that hold no item, or (not keep) that hold one."""

    def run(batches):
        matcher = Matcher(items, per_error)
        for batch in pieces(batches):
            yield batch.filter(pa.array([bool(matcher.find(t or "")) != keep for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, per_error: int = CHARACTERS_PER_ERROR, limit: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, all columns."""
    blocks = item_blocks(benchmark, limit)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return docs.transform(by_batches, _verdicts(first, per_error, True), docs.schema)
    marks = [F.xxhash64("text"), F.xxhash64("text", F.lit("second"))]

    def scan(block):
        texts = docs.select(F.col("text").cast("string").alias("text"), *(m.alias(f"m{k}") for k, m in enumerate(marks)))
        return texts.transform(by_batches, _verdicts(block, per_error, False), texts.schema).select("m0", "m1").distinct()

    gone = _by_blocks(benchmark, limit, scan).withColumnsRenamed({"m0": "_gone0", "m1": "_gone1"})
    return docs.join(gone, (marks[0] == gone["_gone0"]) & (marks[1] == gone["_gone1"]), "left_anti")
