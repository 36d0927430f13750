"""Source divergence audit: how much the sources of a language differ in their words.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Each task counts the (lang, term, source) of its
own documents first, in bounded memory, so that a common word is a few rows of each task and not a row of each document. These
partial runs are dealt by (lang, term) and sorted, by source within a term; one scan over the sorted rows merges them, and at
the end of a term's run its document frequency is known: terms of `MIN_DOCS` documents or more stay. A document is one
row, which lies in one task, so partial document frequencies add up and the sort needs no document id.

The kept runs are dealt again, by language and a hash of the term, behind the group totals of their language as header
rows. A scan turns counts into probabilities in parts per 10**9 and adds each run's part of the pair values and its term values. A
term that both groups of a pair lack adds a constant of the pair, so a run costs its own sources times the sources of the
language, and not the square of these. All arithmetic is on 64-bit whole numbers, divisions in steps that cannot overflow.

A task holds one term's run, the totals of one language, `SUMS` partial sums and the best `TOP` terms of each source.

Defined cases: null text, lang and source are empty strings; equal rows are documents of their own; a language without kept
terms gives its pairs the value 0 and no terms; a language of one source has no pairs; ties go to the smaller item in
UTF-8; very long texts are read whole; empty tables give no rows; documents' other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import by_batches, pieces, stash, utf8

MIN_DOCS = 3
TOP = 200
SCALE = 1000  # three times: parts per 10**9
#: (lang, source, term) that a task holds while it counts (some 100 MB).
HELD = 400_000
#: Tasks that share the terms of one language.
SALTS = 32
#: Cells of numbers that are held at once (some 60 MB with what is made of them).
CELLS = 1 << 20
#: Partial sums of pairs that are held before they are handed on (some 60 MB).
SUMS = 1 << 23
#: ASCII other than letters becomes a blank, capitals small letters; bytes of other characters stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).lower()

_RUNS = "lang string, term string, source string, docs long, n long"


def _count(batches):
    """Partial runs of the task's documents."""
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    occurs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    held = 0

    def told():
        for (lang, source), n in occurs.items():
            terms = sorted(n)  # neighbours have letters in common, which the exchange's compression uses
            for a in range(0, len(terms), 1 << 16):
                part = terms[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([source] * len(part), pa.string()),
                        *(pa.array(np.fromiter(map(x.__getitem__, part), np.int64, len(part))) for x in (docs[lang, source], n)),
                    ],
                    ["lang", "term", "source", "docs", "n"],
                )
        docs.clear()
        occurs.clear()

    for batch in pieces(batches):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), utf8(batch.column("text"))):
            words = text.translate(_LETTERS).split()
            n = occurs[lang, source]
            held -= len(n)
            n.update(words)
            docs[lang, source].update(set(words))
            held += len(n)
            if held > HELD:
                yield from told()
                held = 0
    yield from told()


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row of a batch differs from the row before in one of these columns; the first row always does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _merge(batches):
    """(lang, term, sources, counts) of the terms that stay, from sorted partial runs; a batch's last term waits for the next batch."""
    rest: list[pa.RecordBatch] = []

    def told(rows: pa.RecordBatch):
        lang, term, source, d, n = rows.columns
        new_term = _starts([lang, term])
        new_source = np.flatnonzero(new_term | _starts([source]))
        first = np.flatnonzero(new_term)
        n = np.add.reduceat(n.to_numpy(), new_source)
        stays = np.add.reduceat(d.to_numpy(), first) >= MIN_DOCS
        bounds = np.append(np.searchsorted(new_source, first), len(new_source))
        sizes = np.diff(bounds)[stays]
        if not len(sizes):
            return None
        pick = np.repeat(stays, np.diff(bounds))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        at = pa.array(first[stays])
        return pa.RecordBatch.from_arrays(
            [lang.take(at), term.take(at), pa.ListArray.from_arrays(offsets, source.take(pa.array(new_source[pick]))), pa.ListArray.from_arrays(offsets, pa.array(n[pick]))], ["lang", "term", "sources", "counts"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.flatnonzero(_starts([batch.column("lang"), batch.column("term")]))[-1]
        same = last == 0 and bool(rest) and all(rest[-1].column(c)[-1] == batch.column(c)[0] for c in ("lang", "term"))
        if not same:
            now = pa.concat_batches([*rest, batch.slice(0, last)])
            rest = [batch.slice(last)]
            if now.num_rows and (out := told(now)) is not None:
                yield out
        else:  # a long run: its rows are one for each task and source
            rest.append(batch)
    if rest and (out := told(pa.concat_batches(rest))) is not None:
        yield out


def kept_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, sources, counts): the occurrences of each kept term in each source that has it, sources ascending."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    runs = rows.transform(by_batches, _count, _RUNS)
    # any order in which a term's rows are neighbours will do; the first letters of terms are told apart sooner than languages
    along = runs.repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    return along.transform(by_batches, _merge, "lang string, term string, sources array<string>, counts array<long>")


def per_billion(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """floor(10**9 * x / of) for 0 <= x <= of < 9 * 10**15, in steps that stay within 64 bits."""
    out = x // of
    rest = x - out * of
    for _ in range(3):
        rest = rest * SCALE
        digit = rest // of
        rest -= digit * of
        out = out * SCALE + digit
    return out


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Language:
    """The sums of one language's terms, in one task."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], kept: int):
        self.lang, self.sources, self.at = lang, sources, {s: k for k, s in enumerate(sources)}
        n = np.array(totals, np.int64)
        self.of, self.of_all = np.maximum(n + kept, 1), max(int(n.sum()) + kept, 1)
        self.none = 1 + per_billion(np.ones_like(n), self.of)  # a term that the group lacks
        self.terms = 0
        self.own: dict[int, np.ndarray] = {}  # group -> sums over the other groups, as q
        self.other: dict[int, np.ndarray] = {}  # group -> sums of the other groups, it being q
        self.best: dict[int, list] = defaultdict(list)  # group -> heap of (value, term)
        self.least = np.zeros(len(sources), np.int64)  # of each group, the value that a term must have to be among the best

    def add(self, terms: list[str], sources: list[list[str]], counts: list[list[int]]):
        """Add the runs of some terms; yields partial pairs when many are held."""
        self.terms += len(terms)
        many = np.fromiter(map(len, sources), np.int64, len(sources))
        t = np.repeat(np.arange(len(terms)), many)
        g = np.fromiter((self.at[s] for x in sources for s in x), np.int64, len(t))
        c = np.fromiter((n for x in counts for n in x), np.int64, len(t))
        p = 1 + per_billion(c + 1, self.of[g])
        q = 1 + per_billion(np.add.reduceat(c, np.cumsum(many) - many) + 1, np.int64(self.of_all))
        value = np.where(p > q[t], excess(p, q[t]), -1)
        for k in np.flatnonzero(value >= self.least[g]).tolist():
            self._keep(int(g[k]), int(value[k]), terms[t[k]])
        everywhere = np.tile(self.none, (len(terms), 1))
        everywhere[t, g] = p
        there = np.zeros(everywhere.shape, bool)
        there[t, g] = True
        order = np.argsort(g, kind="stable")
        step = max(1, CELLS // len(self.sources))
        for a in range(0, len(order), step):
            part = order[a : a + step]
            own, rest, mine = g[part], everywhere[t[part]], p[part][:, None]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            none = self.none[own][:, None]
            gain = np.add.reduceat(excess(mine, rest) - excess(none, self.none), first, axis=0)
            lose = np.add.reduceat(np.where(there[t[part]], 0, excess(self.none, mine) - excess(self.none, none)), first, axis=0)
            for k, x, y in zip(own[first].tolist(), gain, lose):
                self.own[k] = self.own.get(k, 0) + x
                self.other[k] = self.other.get(k, 0) + y
            if 2 * len(self.own) * len(self.sources) > SUMS:
                yield from self.sums()
        if len(self.sources) == 1:
            self.own, self.other = {}, {}  # no pairs

    def _keep(self, group: int, value: int, term: str) -> None:
        heap = self.best[group]
        if len(heap) < TOP:
            heapq.heappush(heap, (value, _Last(term)))
        elif (value, _Last(term)) > heap[0]:
            heapq.heapreplace(heap, (value, _Last(term)))
        if len(heap) == TOP:
            self.least[group] = heap[0][0]

    def _batch(self, part: str, source, item, value):
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], _NAMES)

    def _pairs(self, k: int, sums: np.ndarray, mine: bool):
        others = np.arange(len(self.sources)) != k
        one, many = [self.sources[k]] * (len(self.sources) - 1), [s for s, o in zip(self.sources, others) if o]
        return self._batch("pair", *((one, many) if mine else (many, one)), sums[others])

    def sums(self):
        for k, x in self.own.items():
            yield self._pairs(k, x, True)
        for k, x in self.other.items():
            yield self._pairs(k, x, False)
        self.own, self.other = {}, {}

    def end(self):
        """What both groups of a pair lack, the sums that are left, and the best terms."""
        for k in range(len(self.sources) if len(self.sources) > 1 else 0):
            base = self.terms * excess(self.none[k], self.none)
            yield self._pairs(k, base + self.own.pop(k, 0), True)
        yield from self.sums()
        for k, heap in self.best.items():
            yield self._batch("term", [self.sources[k]] * len(heap), [x.term for _, x in heap], [v for v, _ in heap])


class _Last:
    """A term that is the greater, the smaller its UTF-8 is."""

    __slots__ = ("key", "term")

    def __init__(self, term: str):
        self.term, self.key = term, term.encode()

    def __lt__(self, other) -> bool:
        return self.key > other.key

    def __eq__(self, other) -> bool:
        return self.key == other.key


_NAMES = ["lang", "source", "part", "item", "value"]


def _diverge(batches):
    """Rows come by (lang, salt): the header rows with the groups' totals, then the terms."""
    now, groups, language, kept = None, [], None, 0
    for batch in batches:
        at = {name: batch.column(name).to_pylist() for name in ("lang", "salt", "head", "term", "sources", "counts")}
        terms: list[tuple] = []
        for lang, salt, head, term, sources, counts in zip(*at.values()):
            if (lang, salt) != now:
                if language is not None:
                    yield from language.add(*zip(*terms)) if terms else ()
                    yield from language.end()
                now, groups, language, terms = (lang, salt), [], None, []
            if head:
                groups.append((term, counts[0]))
                kept = counts[1]
                continue
            if language is None:
                language = _Language(lang, [s for s, _ in groups], [n for _, n in groups], kept)
            if term is not None:
                terms.append((term, sources, counts))
                if len(terms) * max(len(groups), 1) > CELLS:
                    yield from language.add(*zip(*terms))
                    terms = []
        if terms:
            yield from language.add(*zip(*terms))
    if language is not None:
        yield from language.end()


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: see the module's docstring."""
    runs = stash(kept_runs(docs), "runs")
    counted = runs.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    present = docs.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).agg(F.lit(0).cast("long").alias("n"))
    totals = present.unionByName(counted).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = runs.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = totals.join(kept, "lang", "left").select("lang", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "source", F.array("n", F.coalesce("kept", F.lit(0))).alias("counts"))
    none = F.lit(None).cast("array<string>")
    head = groups.select("lang", "salt", F.lit(True).alias("head"), F.col("source").alias("term"), none.alias("sources"), "counts")
    # one row that ends the header of each language and salt, so that those without terms are told too
    close = head.groupBy("lang", "salt").agg(F.lit(None).cast("string").alias("term")).select("lang", "salt", F.lit(False).alias("head"), "term", none.alias("sources"), F.lit(None).cast("array<long>").alias("counts"))
    body = runs.select("lang", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(False).alias("head"), "term", "sources", "counts")
    dealt = head.unionByName(close).unionByName(body).repartition("lang", "salt").sortWithinPartitions("lang", "salt", F.desc("head"), "term")
    found = dealt.transform(by_batches, _diverge, "lang string, source string, part string, item string, value long")
    values = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term has one value
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(best)).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
