"""Toxicity by maximum-scoring segments.

Words (lower-cased, split at white space and ASCII punctuation) are hashed to buckets. A bucket's weight is the
log-odds of the two labels under a Dirichlet prior shaped like the whole sample, less a drift, so that a plain text
scores negative on average. One linear scan (all maximal segments, by a stack of cumulative sums) finds every passage
whose score no shortening or lengthening can raise. Under plain texts a passage's score follows an extreme-value law, P(best >= x)
about 1 - exp(-K m exp(-lambda x)) for m words; lambda and K are fitted on non-toxic rows that the weights have
not seen. A text's evidence is the sum of lambda x - ln(K m) over its significant passages, and a logistic
curve, fitted on the same rows, turns it into a score.

The model is fitted on about `SAMPLE` labelled rows (a documented bound, by hash of doc_id; a fifth of them
calibrates) and has `BUCKETS` weights; scoring reads every whole text.

Counts are whole numbers of distinct texts over the whole sample, and the calibrating rows are put in order, so the
partitioning of the tables changes nothing.

Defined cases: null, empty and wordless texts have no passage and get the curve's value at no evidence; rows with
a null doc_id or label are never learned from; rows that repeat a doc_id are scored one by one; a doc_id that `labels`
repeats is learned from once for each of its rows (equal texts of one label count once); a text that has both labels counts
for both; very long texts are scanned whole; a passage's ties with a longer one of equal score go to the shorter; held_out
of a null doc_id is false; without rows of both labels, as in empty tables, every score is 0; documents' other columns are
not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import by_batches, pieces
from corvid.llm.language_id import sampled

SAMPLE = 25_000
BUCKETS = 1 << 18
PRIOR = 200.0
DRIFT = 1.0
#: Standard errors taken off a bucket's log-odds.
CAUTION = 2.0
#: ASCII punctuation becomes a blank before words are split.
_PLAIN = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word of all texts in a row, and each text's number of words."""
    split = [t.lower().encode().translate(_PLAIN).split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) & (BUCKETS - 1) for words in split for w in words), np.int64, int(sizes.sum()))
    return flat, sizes


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in one pass.

    Only positive runs enter the stack; a run joins earlier candidates while one with a lower sum to its left
    has also the lower sum at its right end.
    """
    total = np.concatenate(([0.0], np.cumsum(weights)))
    up = np.flatnonzero(weights > 0)
    if not len(up):
        return []
    starts = up[np.diff(up, prepend=-2) > 1]
    ends = up[np.diff(up, append=up[-1] + 2) > 1] + 1
    stack: list[list] = []  # start, end, sum before, sum after
    for a, b, lo, hi in zip(starts.tolist(), ends.tolist(), total[starts].tolist(), total[ends].tolist()):
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= lo:
                k -= 1
            if k < 0 or stack[k][3] >= hi:
                stack.append([a, b, lo, hi])
                break
            a, lo = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def _tally(batches):
    """Texts of each label that hold a bucket (a text that repeats one counts once)."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in pieces(batches):
        flat, sizes = buckets([t or "" for t in batch.column("text").to_pylist()])
        at = 0
        for n, y in zip(sizes.tolist(), batch.column("label").to_pylist()):
            seen[y][np.unique(flat[at : at + n])] += 1
            at += n
    at = np.flatnonzero(seen.any(0))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0][at]), pa.array(seen[1][at])], ["bucket", "n0", "n1"])


def log_odds(n0: np.ndarray, n1: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log-odds of label 1, with a Dirichlet prior of total mass `prior` shaped like the sample."""
    base = (n0 + n1 + 0.01) / (n0 + n1 + 0.01).sum()
    a, b = n1 + prior * base, n0 + prior * base
    odds = np.log(a / (n1.sum() + prior - a)) - np.log(b / (n0.sum() + prior - b))
    # what few texts say is shrunk: some standard errors come off
    error = np.sqrt(1 / a + 1 / b)
    return np.sign(odds) * np.maximum(0, np.abs(odds) - CAUTION * error)


def _evidence(flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray, law) -> list[tuple[float, float, list]]:
    """(evidence, best score, significant passages) of each text."""
    lam, lnk = law
    out, at = [], 0
    for n in sizes.tolist():
        found = segments(weights[flat[at : at + n]].astype(np.float64))
        at += n
        bar = lnk + np.log(max(n, 1))
        strong = [(a, b, lam * s - bar) for a, b, s in found if lam * s > bar]
        out.append((sum(x[2] for x in strong), max((x[2] for x in found), default=0.0), strong))
    return out


def _best(weights):
    def run(batches):
        for batch in pieces(batches):
            flat, sizes = buckets([t or "" for t in batch.column("text").to_pylist()])
            rows = _evidence(flat, sizes, weights, (1.0, 0.0))
            at, passages = 0, []
            for n in sizes.tolist():
                passages.append([s for _, _, s in segments(weights[flat[at : at + n]].astype(np.float64))])
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("m1"), batch.column("label"), pa.array(sizes), pa.array([r[1] for r in rows]), pa.array(passages, pa.list_(pa.float64()))], ["m1", "label", "n", "best", "passages"]
            )

    return run


def extreme_value_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, ln K) of the best scores of texts of n words, by moments of best - ln(n)/lambda, iterated."""
    best, ln = best.astype(float), np.log(np.maximum(n, 1))
    if len(best) < 10 or best.std() == 0:  # plain texts have no passages: less than one in all their words is expected
        return 1.0, -float(np.log(max(1, n.sum())))
    lam = 1.0
    for _ in range(30):
        lam = np.clip(np.pi / (np.sqrt(6) * max(1e-6, (best - ln / lam).std())), 0.2, 5.0)
    lnk = lam * ((best - ln / lam).mean()) - 0.5772156649
    return float(lam), float(lnk)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(slope, offset) of P(y=1) by Newton steps that are halved until they lower the loss, with a small ridge."""

    def loss(at):
        z = at[0] * x + at[1]
        return np.logaddexp(0, z).sum() - (y * z).sum() + 5e-3 * (at @ at)

    now = np.array([0.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(now[0] * x + now[1], -30, 30)))
        w = p * (1 - p)
        grad = np.array([((y - p) * x).sum(), (y - p).sum()]) - 1e-2 * now
        h = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-2 * np.eye(2)
        move = np.linalg.solve(h, grad)
        was = loss(now)
        while loss(now + move) > was and np.abs(move).max() > 1e-9:
            move /= 2
        now = now + move
        if np.abs(move).max() < 1e-8:
            break
    return float(max(now[0], 1e-6)), float(now[1])


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE):
    """(weights, law, curve), or None without rows of both labels."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    picked = sampled(usable.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("label")), bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # the picked labels are at most about `bound` rows of two numbers, so they go to the texts and not the texts to them
    rows = texts.join(F.broadcast(picked), "doc_id").withColumns({"m1": F.xxhash64("text"), "m2": F.xxhash64("text", F.lit("second"))})
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) == 0
    distinct = rows.where(~calibrates).groupBy("m1", "m2", "label").agg(F.first("text").alias("text"))  # equal hashes, equal texts
    counts = distinct.transform(by_batches, _tally, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    n0, n1 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    n0[counts["bucket"]], n1[counts["bucket"]] = counts["n0"], counts["n1"]
    if not n0.sum() or not n1.sum():
        return None
    weights = (log_odds(n0, n1) - DRIFT).astype(np.float32)
    held = rows.where(calibrates).transform(by_batches, _best(weights), "m1 long, label int, n long, best double, passages array<double>").toPandas()
    held = held.sort_values(["m1", "label"], kind="stable", ignore_index=True)
    clean = held[held["label"] == 0]
    law = extreme_value_law(clean["best"].to_numpy(), clean["n"].to_numpy())
    bar = law[1] + np.log(np.maximum(held["n"].to_numpy(), 1))
    evidence = np.array([sum(max(0.0, law[0] * s - b) for s in p) for p, b in zip(held["passages"], bar)])
    y = held["label"].to_numpy(float)
    curve = logistic(np.log1p(evidence), y) if len(set(y)) == 2 else (1.0, -1.0)
    return weights, law, curve


def rate(model, texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """Score of each text, and its number of significant passages."""
    if model is None:
        return np.zeros(len(texts)), [0] * len(texts)
    weights, law, (slope, offset) = model
    found = _evidence(*buckets(texts), weights, law)
    z = slope * np.log1p(np.array([x[0] for x in found])) + offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), [len(x[2]) for x in found]


def _score(model):
    def run(batches):
        for batch in pieces(batches):
            score, passages = rate(model, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(passages, pa.int32())],
                ["doc_id", "held_out", "score", "predicted", "n_passages"],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages."""
    model = fit(docs, labels, bound)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(by_batches, _score(model), "doc_id long, held_out boolean, score double, predicted int, n_passages int")


def _keep(model):
    def run(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(rate(model, [t or "" for t in batch.column("text").to_pylist()])[0] < 0.5))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """The documents that are not predicted toxic, all columns."""
    return docs.transform(by_batches, _keep(fit(docs, labels, bound)), docs.schema)
