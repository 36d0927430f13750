import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

from corvid.llm import language_id as lid
from corvid.llm import packing, toxicity
from corvid.llm.pivot_index import pivot_dedup
from corvid.llm.token_counts import spliced_count, token_counts, tokenizer
from tests.llm.cases import frame, tricky


def links(rows, least=0.98):
    out, parent = Counter(), list(range(len(rows)))

    def ok(v):
        return v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if ok(v) and ok(w) and a is not None and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    out[i] += 1
                    out[j] += 1
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    low = defaultdict(list)
    for i in range(len(rows)):
        low[find(i)].append(rows[i][0])
    return sorted((rows[i][0], out[i], min(low[find(i)])) for i in range(len(rows)))


def test_pivot_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(int(k), [float(x) for x in (base[k % 40] + rng.normal(size=16) * 0.03)], int(k % 4)) for k in range(300)]
    rows += [(400 + k, rows[0][1], 0) for k in range(30)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [1.0, None], 1), (503, [float("nan")] * 16, 1), (504, rows[1][1], None), (505, [1.0, 0.0], 1), (506, [2.0, 0.0], 1), (3, rows[3][1], 3)]
    want = links(rows)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pivot_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert len(got) == len(want)
    assert sum(x[1] for x in got) >= 0.95 * sum(x[1] for x in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert [g for g in got if g[0] >= 500] == [w for w in want if w[0] >= 500]
    assert pivot_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pivot_dedup_dense_group(spark):
    rng = np.random.default_rng(3)
    for n in (2_000, 6_000, 12_000):
        x = rng.normal(size=(n, 64))
        x[: n // 3] = x[0] + rng.normal(size=(n // 3, 64)) * np.sqrt((1 / 0.985 - 1) * (x[0] @ x[0]) / 64)
        x = x.astype(np.float32)
        unit = x / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
        want = (unit @ unit.T >= 0.98).sum(1) - 1
        rows = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
        got = np.array([r.n_links for r in pivot_dedup(rows).orderBy("vec_id").collect()])
        assert (got <= want + 1).all() and got.sum() >= 0.9 * want.sum() > 0


def _recall(spark, x, **options):
    """Share of the true links that are found; none may be found that is not there."""
    unit = x / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    rows = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = np.array([r.n_links for r in pivot_dedup(rows, **options).orderBy("vec_id").collect()])
    assert want.sum() > 0 and (got <= want + 1).all()
    return got.sum() / want.sum()


def _near(rng, x, cosine):
    """Vectors at these cosines to x."""
    side = rng.normal(size=x.shape)
    x = x / np.linalg.norm(x, axis=-1, keepdims=True)
    side -= (side * x).sum(-1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=-1, keepdims=True)
    return cosine[:, None] * x + np.sqrt(1 - cosine**2)[:, None] * side


def test_pivot_recall_of_planted_pairs(spark):
    rng = np.random.default_rng(9)
    for pivots in (64, 512, 2048):
        base = rng.normal(size=(1500, 64))
        x = np.concatenate([base, _near(rng, base, rng.uniform(0.9801, 0.99, len(base)))])
        assert _recall(spark, x, pivots=pivots) >= 0.95


def test_pivot_recall_of_groups(spark):
    rng = np.random.default_rng(10)
    for dims, alone, group in ((64, 2000, 1000), (16, 0, 300)):
        x = rng.normal(size=(alone + group, dims))
        x[:group] = _near(rng, np.repeat(x[:1], group, 0), rng.uniform(0.985, 0.995, group))
        assert _recall(spark, x) >= 0.95


def test_pivot_dedup_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 1, 5, 6, "k"), (2, [1.0, 0.01], 1, 5, 6, "k"), (2, [0.0, 1.0], 1, 5, 6, "k")]
    out = pivot_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links long, class long, key string"))
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, True), (2, 0, 2, True), (2, 1, 1, False)]


def test_packed_documents_follow_the_curve(spark):
    rng = random.Random(12)
    words = [[f"{c}{k}" for k in range(40)] for c in "abcdefgh"]
    rows = [(k, " ".join(rng.choice(words[k % 8]) for _ in range(rng.randint(1, 80))), None, None, None, 1, "") for k in range(400)]
    path = public_tokenizers.path(packing.VOCABULARY)
    coded = {r.doc_id: r.curve for r in frame(spark, rows).select("doc_id", "text").mapInArrow(packing._encode(path), "doc_id long, curve long, tie long, ids binary").collect()}
    place = {}
    for r in packing.pack(frame(spark, rows), path, 256).collect():
        place[r.doc_id] = min(place.get(r.doc_id, (1 << 62, 0)), (r.sequence_id, r.offset))
    walk = [coded[d] for d, _ in sorted(place.items(), key=lambda x: x[1])]
    assert sum(a > b for a, b in zip(walk, walk[1:])) <= 8 < len(set(walk))  # rests at the ends of tasks come in pieces
    assert len(set(coded.values())) > 100


def test_pivot_dedup_rare_length(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(rng.normal(size=(4000, 8)))]
    rows += [(k + 5000, [float("nan"), None][k % 2 : k % 2 + 1] + [float(k)] * 7, 0) for k in range(300)]
    rows += [(9000 + n, [1.0, n + 1.0] + [0.0] * n, 0) for n in range(20, 40)] + [(9100 + n, [2.0, 2 * n + 2.0] + [0.0] * n, 0) for n in range(20, 40)]
    out = pivot_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).where("vec_id >= 9000")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect()) == sorted((k + n, 1, 9000 + n) for k in (9000, 9100) for n in range(20, 40))


def test_tokens(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizer(path)
    plain = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcé'.!<|") for _ in range(rng.randint(1, 9))) for _ in range(4000)) + "<|endoftext|>" + "ab" * 3000 + "\n\n" + "x y" * 900
    for chunk, overlap in ((700, 30), (5000, 200), (100_000, 5)):
        assert spliced_count(tok, text, chunk, overlap) == plain(text)
    assert spliced_count(tok, "ab" * 5000, 600, 20) == plain("ab" * 5000)
    rows = tricky() + [(77, text, None, None, None, 1, "")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark, rows), path, chunk=3000).collect())
    assert got == sorted((d is None, d or 0, len((t or "").encode()), plain(t or ""), plain(t or "") > 2048) for d, t, *_ in rows)
    assert token_counts(frame(spark, []), path).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in tricky() if r[0] is not None and r[:2] != (5, tricky()[4][1])] + [(90, "a<|endoftext|>b " * 2000, None, None, None, 1, "")]
    ids = {d: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in rows}
    out = packing.pack(frame(spark, rows), public_tokenizers.path(packing.VOCABULARY), 256).collect()
    place = defaultdict(list)
    seen = defaultdict(list)
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        place[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.start, r.length))
    for spans in (*place.values(), *seen.values()):
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
    assert all((n := sum(x[1] for x in s)) == 256 or n & (n - 1) == 0 for s in place.values())
    assert all(sum(x[1] for x in seen[d]) == len(i) for d, i in ids.items())
    assert packing.pack(frame(spark, []), public_tokenizers.path(packing.VOCABULARY)).count() == 0


def test_remembered_stretches_equal_whole_encoding():
    path = public_tokenizers.path(packing.VOCABULARY)
    enc = packing.Encoder(path)
    whole = enc.tok
    rng = random.Random(5)
    parts = [" ", " ", " ", "  ", "\n", " \n", "\t ", "\x1c", "\u00a0", "\u3000 ", "a", "bc", "it's", "'s", "12", "é", "日本", "\U0001f600", "e\u0301", "<|endoftext|>", "<|end", "!?", "\x00", "…", "²", "Ⅷ", "...", "a,", ".b", "|>", "(c)", "\u0301"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(50)]
        assert [x.tolist() for x in enc.ids(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_hilbert_curve_steps_to_neighbours():
    side = 8
    grid = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(side**3))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_segments_against_brute_force():
    rng = random.Random(7)
    for _ in range(500):
        w = np.array([rng.choice([-2, -1, 1, 2, 3]) for _ in range(rng.randint(0, 14))], float)
        found = toxicity.segments(w)
        best = max((w[a:b].sum() for a in range(len(w)) for b in range(a + 1, len(w) + 1)), default=0)
        assert max((s for *_, s in found), default=0) == max(0, best)
        total = np.concatenate(([0], np.cumsum(w)))
        for a, b, s in found:  # every proper prefix and suffix of a maximal segment scores more than nothing
            assert s == w[a:b].sum() and all(total[a] < total[k] for k in range(a + 1, b + 1)) and all(total[k] < total[b] for k in range(a, b))
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        assert sum(1 for k in range(len(w)) if w[k] > 0) == sum(1 for k in range(len(w)) if w[k] > 0 and any(a <= k < b for a, b, _ in found))


def test_models_on_small_tables(spark):
    rng = random.Random(3)
    words = {"en": "the of and thing with".split(), "de": "der und schön nicht ßig".split(), "fr": "le été que dans être".split()}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(rng.randint(5, 60))), x, "s", 1, 1, "") for k in range(600) for x in [rng.choice(list(words))]]
    odd = [(700, None, "en", None, None, 1, ""), (701, "12 34 !!", "de", None, None, 1, ""), (None, "der und", None, None, None, 1, ""), (702, "le été", None, None, None, 1, "")]
    out = lid.language_id(frame(spark, rows + odd)).collect()
    truth = {d: x for d, _, x, *_ in rows}
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert {r.doc_id: r.lang_pred for r in out}[700] == "und" == {r.doc_id: r.lang_pred for r in out}[701]
    assert {r.lang_pred for r in lid.language_id(frame(spark, odd[:2])).collect()} == {"und"}
    assert lid.language_id(frame(spark, [])).count() == 0

    plain = [f"w{k}" for k in range(200)]
    texts = [[rng.choice(plain) for _ in range(rng.randint(5, 200))] for _ in range(900)]
    bad = [rng.random() < 0.3 for _ in texts]
    for t, b in zip(texts, bad):
        if b:
            t.insert(rng.randrange(len(t)), rng.choice(["nasty", "vile"]))
    docs = frame(spark, [(k, " ".join(t), "en", "s", 1, 1, "") for k, t in enumerate(texts)] + [(None, "vile", None, None, None, 1, ""), (2000, None, None, None, None, 1, ""), (2001, "", None, None, None, 1, "")])
    labels = spark.createDataFrame([(k, 1, int(b)) for k, b in enumerate(bad)] + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert np.mean([r.predicted == bad[r.doc_id] for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]) > 0.95
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.schema == docs.schema and kept.count() == sum(1 for r in out if not r.predicted)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0


def test_stretches_that_hash_alike_keep_their_ids(monkeypatch):
    """Words over two letters in the Thue-Morse order collide under any polynomial hash modulo 2**64; then all hashes alike."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = packing.Encoder(path)
    whole = lambda texts: [e.ids for e in enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    word = lambda n, a, b: "".join(b if k.bit_count() & 1 else a for k in range(n))
    for n in (512, 1024, 2048, 4096):
        texts = [f"q {word(n, 'a', 'b')}", f"q {word(n, 'b', 'a')}", word(n, "a", "b"), f"{word(n, 'b', 'a')} x", f"q {word(n, 'b', 'a')} q"]
        assert [x.tolist() for x in enc.ids(texts)] == whole(texts)
        assert [x.tolist() for x in enc.ids(texts[::-1])] == whole(texts[::-1])
    rng = random.Random(2)
    some = ["a", "b", "é ", " ", " \t", "the ", "ß9", "\n", "<|endoftext|>", "x" * 5000]
    texts = [None, "", *("".join(rng.choices(some, [9, 9, 9, 9, 1, 5, 5, 2, 1, 0.1], k=rng.randint(0, 40))) for _ in range(3000))]
    assert [x.tolist() for x in enc.ids(texts)] == whole(texts)
    monkeypatch.setattr(packing, "stretch_keys", lambda raw, start, end: ((end - start) % 3).astype(np.uint64))
    enc.forget()
    for part in (texts[:400], texts[400:800]):
        assert [x.tolist() for x in enc.ids(part)] == whole(part)
        enc.shrink()
