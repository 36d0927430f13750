"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

A text becomes `len(STATISTICS)` numbers (shares of kinds of characters, words and lines, repetition, lengths, entropy). Standardised
and turned by fixed random frequencies, their cosines approximate a Gaussian kernel. Each partition of the sample sums its
normal equations, the driver adds these (a matrix of a few hundred columns) and solves the ridge system; pool-adjacent-violators on
rows that the system has not seen turns fitted values into probabilities, joined by straight lines.

The model is fitted on about `SAMPLE` labelled rows (a documented bound, by hash of doc_id; a fifth of them calibrates);
scoring reads every whole text. Statistics and features are rounded to fixed point before they are summed, so the partitioning
of the tables changes nothing.

Defined cases: null texts count as empty, and an empty text has statistics too (all zero); rows with a null doc_id or label are
never learned from; rows that repeat a doc_id are scored one by one; a doc_id that `labels` repeats is learned from once for
each of its rows; held_out of a null doc_id is false; fitted values that tie get one score; without labelled rows, as in empty
tables, every score is 0, and with rows of one label, or too few to calibrate, the scores are the labels' mean; very long texts
are read whole; documents' other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import by_batches, grams, pieces, stash, utf8, word_hashes
from corvid.llm.language_id import sampled

SAMPLE = 25_000
FREQUENCIES = 256
#: Width of the Gaussian kernel, in standard deviations of one statistic times the root of their number.
WIDTH = 0.7
#: Ridge, for each row of the sample.
RIDGE = 1e-3
THRESHOLD = 0.7
#: Partitions of the sample's statistics, each of which sums its own normal equations.
SHARDS = 16
#: One, in fixed point: of a statistic, and of a feature. Sums of products stay below 2**53.
STATISTIC, FEATURE = 1 << 12, 1 << 13

KINDS = ("lower", "upper", "digit", "blank", "newline", "stop", "comma", "symbol", "wide")
STATISTICS = (
    *KINDS, "chars", "words", "lines", "word_mean", "word_spread", "word_short", "word_long", "starts_upper", "starts_symbol", "ends_stop", "ends_symbol",
    "per_stop", "distinct", "distinct_pairs", "distinct_lines", "line_mean", "entropy",
)


def _kinds() -> np.ndarray:
    out = np.full(256, KINDS.index("symbol"), np.uint8)
    for kind, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", (32, 9, 11, 12, 13)), ("newline", (10,)), ("stop", b".!?"), ("comma", b",;:'\"()-"), ("wide", range(128, 256))):
        out[list(chars)] = KINDS.index(kind)
    return out


_KIND = _kinds()


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of numbers, about 0 to 10 each, for each text, in fixed point."""
    n = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(n)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    kind = _KIND[flat]
    some = np.maximum(n, 1)
    count = {k: _sums(kind == i, ends) for i, k in enumerate(KINDS)}
    out = {k: count[k] / some for k in KINDS}
    # words lie between blanks; a text's first byte begins one too
    space = (kind == KINDS.index("blank")) | (kind == KINDS.index("newline"))
    fresh = np.zeros(len(flat) + 1, bool)
    fresh[ends] = True
    fresh[0] = True
    before = np.concatenate(([True], space)) | fresh
    start = np.flatnonzero(~space & before[:-1])
    after = np.concatenate((space[1:], [True])) | fresh[1:]
    stop = np.flatnonzero(~space & after)
    size = stop - start + 1
    first = np.searchsorted(start, np.concatenate(([0], ends)))  # of each text, its first word
    words = np.diff(first)
    many, to = np.maximum(words, 1), first[1:]
    of = lambda x: _sums(x, to) / many
    capped = np.minimum(size, 64)
    mean = of(capped)
    out |= {
        "chars": np.log1p(n) / 2, "words": np.log1p(words) / 2, "lines": np.log1p(count["newline"]) / 2, "word_mean": mean / 4, "word_spread": np.sqrt(np.maximum(of(capped * capped) - mean * mean, 0)) / 4,
        "word_short": of(size <= 3), "word_long": of(size > 15), "starts_upper": of(kind[start] == 1), "starts_symbol": of(kind[start] == 7), "ends_stop": of(kind[stop] == 5), "ends_symbol": of(kind[stop] == 7),
        "per_stop": np.log1p(words / (1 + count["stop"])), "line_mean": np.log1p(n / (1 + count["newline"])) / 2,
    }
    hashes, numbers = word_hashes(texts)
    distinct, pairs, lines, entropy = (np.zeros(len(texts)) for _ in range(4))
    at = 0
    for k, (t, m) in enumerate(zip(texts, numbers.tolist())):
        own = hashes[at : at + m]
        at += m
        if not m:
            continue
        distinct[k] = len(np.unique(own)) / m
        pairs[k] = len(np.unique(grams(own, 2))) / (m - 1) if m > 1 else 1
        rows = t.split(b"\n")
        lines[k] = len(set(rows)) / len(rows)
        share = np.bincount(np.frombuffer(t, np.uint8), minlength=256) / len(t)
        entropy[k] = -(share[share > 0] * np.log2(share[share > 0])).sum() / 4
    out |= {"distinct": distinct, "distinct_pairs": pairs, "distinct_lines": lines, "entropy": entropy}
    return np.rint(np.stack([out[k] for k in STATISTICS], 1) * STATISTIC).astype(np.int64)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # fitted values, ascending
    levels: np.ndarray  # the scores there

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.fitted(stats), self.knots, self.levels)

    def fitted(self, stats: np.ndarray) -> np.ndarray:
        # whole numbers of limited size times weights that are rounded to 2**-30, so the order of the sum changes nothing
        return features(stats, self.mean, self.spread) @ self.weights / FEATURE


def _frequencies() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    n = len(STATISTICS)
    return rng.normal(size=(n, FREQUENCIES)) / (WIDTH * np.sqrt(n)), rng.uniform(0, 2 * np.pi, FREQUENCIES)


def features(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """One, the standardised statistics and the cosines, as whole numbers in float64."""
    x = np.clip((stats - mean) / spread, -4, 4)
    turn, shift = _frequencies()
    # each row alone, in one order of additions: a matrix product may differ in the last digit with the number of rows
    waves = np.cos(np.einsum("ij,jk->ik", x, turn) + shift)
    return np.rint(np.concatenate([np.ones((len(x), 1)), x / 4, waves], 1) * FEATURE)


def _measure(batches):
    for batch in pieces(batches):
        stats = statistics(utf8(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("calibrates"), pa.array(list(stats), pa.list_(pa.int64()))], ["doc_id", "label", "calibrates", "stats"])


def _matrix(batch) -> np.ndarray:
    return np.array(batch.column("stats").to_pylist(), np.int64).reshape(-1, len(STATISTICS))


def _moments(batches):
    total = np.zeros((2, len(STATISTICS)), np.int64)
    n = 0
    for batch in batches:
        x = _matrix(batch)
        total += np.stack([x.sum(0), (x * x).sum(0)])
        n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "total"])


def _equations(mean, spread):
    def run(batches):
        total = 0
        for batch in batches:
            z = features(_matrix(batch), mean, spread)
            z = np.concatenate([z, np.array(batch.column("label").to_pylist(), float)[:, None] * FEATURE], 1)
            total = total + z.T @ z  # whole numbers below 2**53: exact
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the least-squares ascending fit (pool adjacent violators); a block's knots are its ends."""
    at, where = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # mean, weight, first, last
    for value, weight, mean in zip(at.tolist(), np.bincount(where).tolist(), (np.bincount(where, y) / np.bincount(where)).tolist()):
        blocks.append([mean, weight, value, value])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            low = blocks[-1]
            blocks[-1] = [(low[0] * low[1] + m * w) / (low[1] + w), low[1] + w, low[2], last]
    middle = np.array([(b[2] + b[3]) / 2 for b in blocks])
    return middle, np.array([b[0] for b in blocks])


def solve(total: np.ndarray, rows: int) -> np.ndarray:
    """Ridge weights from the summed normal equations; the constant is not shrunk."""
    a, b = total[:-1, :-1] / FEATURE**2, total[:-1, -1] / FEATURE**2
    ridge = np.full(len(b), RIDGE * rows)
    ridge[0] = 1e-6
    return np.rint(np.linalg.solve(a + np.diag(ridge), b) * 2**30) / 2**30


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model | float | None:
    """The model; the labels' mean where there is too little to fit; None without labelled rows."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    picked = sampled(usable.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") != 0).cast("int").alias("label")), bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) == 0
    # the picked labels are at most about `bound` rows of two numbers, so they go to the texts and not the texts to them
    rows = texts.join(F.broadcast(picked), "doc_id").withColumn("calibrates", calibrates)
    measured = stash(rows.transform(by_batches, _measure, "doc_id long, label int, calibrates boolean, stats array<long>").repartition(SHARDS, "doc_id"), "statistics")
    learns, judges = measured.where("not calibrates"), measured.where("calibrates")
    sums = learns.transform(by_batches, _moments, "n long, total binary").collect()
    n = sum(r.n for r in sums)
    tests = judges.select("label", "stats").toPandas()  # a fifth of the sample, some 30 numbers a row
    if not n:
        return float(tests["label"].mean()) if len(tests) else None
    total = sum(np.frombuffer(r.total, np.int64).reshape(2, -1) for r in sums)
    mean = total[0] / n
    spread = np.sqrt(np.maximum(total[1] / n - mean * mean, 0))
    spread = np.where(spread < 1, STATISTIC, spread)  # what never differs says nothing
    equations = sum(np.frombuffer(r.total).reshape(1 + len(STATISTICS) + FREQUENCIES + 1, -1) for r in learns.transform(by_batches, _equations(mean, spread), "total binary").collect())
    positive = equations[0, -1] / FEATURE**2 + tests["label"].sum()
    if not 0 < positive < n + len(tests) or not len(tests):
        return float(positive / (n + len(tests)))
    model = Model(mean, spread, solve(equations, n), np.zeros(1), np.zeros(1))
    knots, levels = isotonic(model.fitted(np.array(tests["stats"].tolist(), np.int64)), tests["label"].to_numpy(float))
    return Model(mean, spread, model.weights, knots, levels)


def rate(model: Model | float | None, texts: list[bytes]) -> np.ndarray:
    if not isinstance(model, Model):
        return np.full(len(texts), model or 0.0)
    return model.score(statistics(texts))


def _score(model):
    def run(batches):
        for batch in pieces(batches):
            score = rate(model, utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, bound)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(by_batches, _score(model), "doc_id long, held_out boolean, score double, predicted int")
