"""Language identification by error-correcting output codes.

Each language has a codeword of +-1 bits; more languages get longer ones, so that errors stay correctable. For each bit a
naive-Bayes classifier on hashed byte trigrams of the lower-cased text tells the languages with +1 from those with -1. A
text's margins are the classifiers' mean log-ratios, scaled by their training spread; the codeword with the least loss,
weighted by each bit's training accuracy, wins. The softmax of the losses is the score; a small lead of the winner flags
the answer as ambiguous.

The model is fitted on about `SAMPLE` learnable rows (a documented bound, chosen by hash of doc_id); its size is
bits x `BUCKETS` and does not grow with the data. Shares and weights are whole numbers (fixed point), so neither the order nor
the partitioning of rows nor a text's neighbours change a digit. Prediction reads every whole text.

Defined cases: null texts and texts without a letter are `und` with score 0; rows with a null lang or a null doc_id
are never learned from and are predicted like others; held_out of a null doc_id is false; with no learnable row at
all every answer is `und`; ties go to the first language in alphabetical order; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import by_batches, pieces

SAMPLE = 20_000
BUCKETS = 1 << 14
#: Bits of a codeword: at least so many, and so many for each doubling of the number of languages.
BITS = 15
BITS_PER_DOUBLING = 8
AMBIGUOUS = 0.2
#: One, in fixed point: of a text's share of a trigram, and of a weight.
SHARE = 1 << 32
WEIGHT = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
STEP = 1 << 16


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram of all texts in a row (each text alone, between blanks), and each text's number of them."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    flat = np.frombuffer(b"".join([b" " + t + b" " for t in texts]) + b"  ", np.uint8).astype(np.uint32)
    code = (flat[:-2] | flat[1:-1] << np.uint32(8) | flat[2:] << np.uint32(16)) * np.uint32(2654435761)
    inside = np.ones(len(code), bool)
    inside[np.cumsum(sizes + 1) - 1] = False  # what begins at the closing blank would reach into the next text
    return (code >> np.uint32(18))[inside], sizes


def length(n: int) -> int:
    """Bits of the codewords of n languages."""
    return max(BITS, BITS_PER_DOUBLING * max(0, n - 1).bit_length())


def codewords(n: int, bits: int | None = None) -> np.ndarray:
    """n rows of +-1 with large mutual distance: the best of seeded random tries; each bit splits the languages."""
    bits = bits or length(n)
    best, score = None, -1
    rng = np.random.default_rng(7)
    for _ in range(200):
        m = rng.integers(0, 2, (max(n, 1), bits)) * 2 - 1
        flat = np.flatnonzero(np.abs(m.sum(0)) == len(m))
        if len(m) > 1:
            m[rng.integers(0, len(m)), flat] *= -1
        agree = m @ m.T
        np.fill_diagonal(agree, -bits)
        gap = int(bits - agree.max()) // 2 if len(m) > 1 else 0
        if gap > score:
            best, score = m, gap
    return best


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))


def sampled(rows: DataFrame, bound: int) -> DataFrame:
    """About `bound` rows (all, if there are fewer), by hash of doc_id; the same ones each time."""
    share = min(1.0, bound / max(1, rows.count()))
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def _tally(batches):
    """(lang, bucket, total): each text weighs the same, so that long ones don't drown the rest."""
    seen: dict[str, np.ndarray] = {}

    def told():
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "total"])
        seen.clear()

    for batch in pieces(batches):
        texts = [(t or "").lower().encode() for t in batch.column("text").to_pylist()]
        code, sizes = trigrams(texts)
        ends = np.cumsum(sizes)
        for lang, end, n in zip(batch.column("lang").to_pylist(), ends.tolist(), sizes.tolist()):
            if lang not in seen:
                seen[lang] = np.zeros(BUCKETS, np.int64)
            seen[lang] += np.bincount(code[end - n : end], minlength=BUCKETS) * SHARE // n
        if len(seen) > 200:
            yield from told()
    yield from told()


def classifiers(share: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights[BUCKETS, bits] in fixed point, trust of each bit) from the languages' trigram shares (rows that sum to 1)."""
    prior = 0.5 / share.shape[1]
    bits = code.shape[1]
    weights, trust = np.empty((share.shape[1], bits), np.int32), np.empty(bits)
    for b in range(bits):
        up, down = (share[code[:, b] == s].mean(0) if (code[:, b] == s).any() else np.zeros(share.shape[1]) for s in (1, -1))
        w = np.log((up + prior) / (down + prior))
        expected = share @ w  # each language's mean margin
        # centred and scaled so that the languages' own margins are about +-1
        middle = (expected[code[:, b] == 1].min(initial=1) + expected[code[:, b] == -1].max(initial=-1)) / 2 if len(share) > 1 else 0
        spread = np.abs(expected - middle).min() if len(share) > 1 else 1
        weights[:, b] = np.rint(np.clip((w - middle) / max(spread, 1e-6), -1000, 1000) * WEIGHT)
        trust[b] = np.mean(np.sign(expected - middle) == code[:, b]) * min(1.0, spread)
    return weights, trust / max(trust.sum(), 1e-9)


def fit(docs: DataFrame, bound: int = SAMPLE):
    """(languages, codewords, weights, bit weights), all on the driver; None if nothing can be learned."""
    rows = sampled(learnable(docs).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), bound)
    # at most `BUCKETS` rows per language, and no more than the sample has trigrams
    tallies = rows.transform(by_batches, _tally, "lang string, bucket int, total long").groupBy("lang", "bucket").agg(F.sum("total").alias("total")).toPandas()
    if tallies.empty:
        return None
    langs = sorted(tallies["lang"].unique())
    share = np.zeros((len(langs), BUCKETS))
    share[np.searchsorted(langs, tallies["lang"]), tallies["bucket"]] = tallies["total"]
    share = share / share.sum(1, keepdims=True)
    code = codewords(len(langs))
    return langs, code, *classifiers(share, code)


def decode(margins: np.ndarray, code: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winner, score and ambiguity of each row of margins: loss exp(-bit * margin), weighted by the bits' trust."""
    m = np.clip(margins, -4, 4)
    loss = (np.exp(-m) * trust) @ (code == 1).T + (np.exp(m) * trust) @ (code == -1).T
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    # what only rounding tells apart is a tie, and goes to the first language
    win = (p >= p.max(1, keepdims=True) - 1e-12).argmax(1)
    score = p[np.arange(len(p)), win]
    second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    return win, score, score - second < AMBIGUOUS


def _predict(model):
    def run(batches):
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lang, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            some = [k for k, t in enumerate(texts) if _LETTER.search(t)]
            if model is not None and some:
                langs, code, weights, trust = model
                grams, sizes = trigrams([texts[k].lower().encode() for k in some])
                sums = np.zeros((len(some), code.shape[1]), np.int64)
                owner = np.repeat(np.arange(len(some)), sizes)
                for a in range(0, len(grams), STEP):
                    part = owner[a : a + STEP]
                    first = np.flatnonzero(np.diff(part, prepend=-1))
                    np.add.at(sums, part[first], np.add.reduceat(weights[grams[a : a + STEP]], first, axis=0, dtype=np.int64))
                win, s, d = decode(sums / (sizes[:, None] * float(WEIGHT)), code, trust)
                for k, w in zip(some, win):
                    lang[k] = langs[w]
                score[some], doubt[some] = s, d
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(doubt)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def language_id(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    model = fit(docs, bound)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(by_batches, _predict(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
