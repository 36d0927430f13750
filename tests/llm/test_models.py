"""The fitted operators against plain second versions, and against themselves under other partitionings and batches."""

import math
import random

import numpy as np
import pytest
import xxhash

from corvid.llm import language_id as lid
from corvid.llm import toxicity
from tests.llm.cases import frame


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = {"en": "the of and thing with".split(), "de": "der und schön nicht ßig".split(), "fr": "le été que dans être".split(), "es": "el los una ción que".split()}
    texts = [(x, " ".join(rng.choice(words[x]) for _ in range(rng.randint(1, 60)))) for _ in range(400) for x in [rng.choice(list(words))]]
    rows = [(k, t + (" vile nasty" if rng.random() < 0.3 else ""), x, "s", 1, 1, "") for k, (x, t) in enumerate(texts)]
    rows += [(1000 + k, rows[k % 7][1], rows[k % 7][2], "s", 1, 1, "") for k in range(200)]  # repeated texts
    labels = [(d, 1, int("vile" in t)) for d, t, *_ in rows]
    return rows, labels


def test_trigrams_of_a_text_do_not_see_its_neighbours():
    texts = [b"an", b"", b"x", b"\xc3\xa9t\xc3\xa9 la", b"an"]
    flat, sizes = lid.trigrams(texts)
    ends = np.cumsum(sizes)
    for t, end, n in zip(texts, ends, sizes):
        padded = b" " + t + b"  "
        want = [(padded[k] | padded[k + 1] << 8 | padded[k + 2] << 16) * 2654435761 % 2**32 >> 18 for k in range(len(t) + 1)]
        assert flat[end - n : end].tolist() == want == lid.trigrams([t])[0].tolist()


@pytest.mark.parametrize("n, least", [(1, 0), (2, 5), (4, 6), (50, 8), (200, 8)])
def test_codewords_stay_correctable(n, least):
    code = lid.codewords(n)
    assert code.shape == (n, lid.length(n)) and set(np.unique(code)) <= {-1, 1}
    if n > 1:
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= least
        assert (np.abs(code.sum(0)) < n).all()  # each bit splits the languages


def test_decode_against_loop():
    rng = np.random.default_rng(2)
    code, trust = lid.codewords(6), rng.random(lid.length(6))
    margins = rng.normal(size=(40, lid.length(6))) * 2
    win, score, doubt = lid.decode(margins, code, trust)
    for m, w, s, d in zip(margins, win, score, doubt):
        loss = [sum(t * math.exp(-max(-4, min(4, b * x))) for t, b, x in zip(trust, row, m)) for row in code]
        p = [math.exp(-4 * (x - min(loss))) for x in loss]
        p = [x / sum(p) for x in p]
        assert w == p.index(max(p)) and abs(s - max(p)) < 1e-9 and d == (sorted(p)[-1] - sorted(p)[-2] < lid.AMBIGUOUS)


def test_classifiers_against_loop():
    rng = np.random.default_rng(5)
    share = rng.random((5, 12))
    share /= share.sum(1, keepdims=True)
    code = lid.codewords(5)
    weights, trust = lid.classifiers(share, code)
    plain = []
    for b in range(code.shape[1]):
        groups = {s: [share[k] for k in range(5) if code[k, b] == s] for s in (1, -1)}
        w = [math.log((np.mean([g[c] for g in groups[1]]) + 0.5 / 12) / (np.mean([g[c] for g in groups[-1]]) + 0.5 / 12)) for c in range(12)]
        mean = [sum(p * x for p, x in zip(row, w)) for row in share]
        middle = (min([1, *(mean[k] for k in range(5) if code[k, b] == 1)]) + max([-1, *(mean[k] for k in range(5) if code[k, b] == -1)])) / 2
        spread = min(abs(m - middle) for m in mean)
        assert np.allclose(weights[:, b] / lid.WEIGHT, [(x - middle) / spread for x in w], atol=1e-5)
        plain.append(np.mean([np.sign(m - middle) == code[k, b] for k, m in enumerate(mean)]) * min(1, spread))
    assert np.allclose(trust, np.array(plain) / sum(plain))


def _told(df, *names):
    return sorted((r.doc_id, *(getattr(r, n) for n in names)) for r in df.collect())


def test_partitioning_changes_nothing(spark, corpus):
    rows, labels = corpus
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first = _told(lid.language_id(docs.coalesce(1)), "lang_pred", "score"), _told(toxicity.toxicity(docs.coalesce(1), marks), "score")
    for n in (4, 16):
        again = _told(lid.language_id(docs.repartition(n)), "lang_pred", "score"), _told(toxicity.toxicity(docs.repartition(n), marks.repartition(n)), "score")
        for a, b in zip(first, again):
            assert [x[:-1] for x in a] == [x[:-1] for x in b]
            assert max(abs(x[-1] - y[-1]) for x, y in zip(a, b)) < 1e-9


def test_alone_or_in_a_batch(spark, corpus):
    rows, labels = corpus
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    import pyarrow as pa

    texts = [t for _, t, *_ in rows[:80]] + ["an", "", "x" * 300_000]
    model = lid.fit(docs)
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array([False] * len(some)), pa.array(some)], ["doc_id", "held_out", "text"])
    told = lambda some: [(r["lang_pred"], r["score"]) for b in lid._predict(model)([batch(some)]) for r in b.to_pylist()]
    for a, b in zip(told(texts), [told([t])[0] for t in texts]):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-9
    model = toxicity.fit(docs, marks)
    assert np.abs(toxicity.rate(model, texts)[0] - [toxicity.rate(model, [t])[0][0] for t in texts]).max() < 1e-9


def test_toxicity_fit_against_loops(spark, corpus):
    rows, labels = corpus
    marks = spark.createDataFrame([*labels, labels[0], (labels[1][0], 1, 1 - labels[1][2])], "doc_id long, quality int, toxic int")
    weights, law, curve = toxicity.fit(frame(spark, rows), marks)
    n = {0: {}, 1: {}}
    import zlib

    kept = {(d, t, y) for d, t, *_ in rows for e, _, y in [*labels, (labels[1][0], 1, 1 - labels[1][2])] if d == e and zlib.crc32(str(d).encode()) % 5}
    part = {r.doc_id: r.p for r in frame(spark, rows).selectExpr("doc_id", "pmod(xxhash64(doc_id, 'part'), 5) = 0 as p").collect()}
    for t, y in {(t, y) for d, t, y in kept if not part[d]}:
        for w in set(t.lower().split()):
            b = xxhash.xxh3_64_intdigest(w.encode()) & (toxicity.BUCKETS - 1)
            n[y][b] = n[y].get(b, 0) + 1
    total = {y: sum(n[y].values()) for y in n}
    whole = total[0] + total[1] + 0.01 * toxicity.BUCKETS
    for b in {*n[0], *n[1]}:
        base = (n[0].get(b, 0) + n[1].get(b, 0) + 0.01) / whole
        a1, a0 = n[1].get(b, 0) + toxicity.PRIOR * base, n[0].get(b, 0) + toxicity.PRIOR * base
        odds = math.log(a1 / (total[1] + toxicity.PRIOR - a1)) - math.log(a0 / (total[0] + toxicity.PRIOR - a0))
        odds = math.copysign(max(0, abs(odds) - toxicity.CAUTION * math.sqrt(1 / a1 + 1 / a0)), odds)
        assert abs(weights[b] - (odds - toxicity.DRIFT)) < 1e-4


def test_logistic_has_no_slope_left():
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x + 1))).astype(float)
    a, b = toxicity.logistic(x, y)
    loss = lambda a, b: np.logaddexp(0, a * x + b).sum() - (y * (a * x + b)).sum() + 5e-3 * (a * a + b * b)
    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-9 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


def test_extreme_value_law_finds_its_parameters():
    rng = np.random.default_rng(4)
    n = rng.integers(50, 2000, 20_000)
    best = (np.log(n) + math.log(0.1) + rng.gumbel(size=len(n))) / 0.8
    lam, lnk = toxicity.extreme_value_law(best, n)
    assert abs(lam - 0.8) < 0.02 and abs(lnk - math.log(0.1)) < 0.1
