"""Conversation repair, quality and source divergence against plain second versions, odd rows and other partitionings."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from corvid.llm import conversation_repair as repair
from corvid.llm import quality
from corvid.llm import source_divergence as divergence
from tests.llm.cases import frame

SCHEMA = "conv_id long, turn long, role string, text string, cid string, kind string, digest string, numbers string"


# conversation repair


def plain_damage(rows):
    """Rows of each conversation after damage, in order, by the contract's words."""
    out = {}
    for conv, turn, role, text in rows:
        keep = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        keep += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    md5 = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, md5(r))) for c, x in out.items()}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        text = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not text else "duplicate" if (role, rows[len(out)][2]) in seen else "" if text[-1] in ".!?" else "truncated"
        seen.add((role, rows[len(out)][2]))
        out.append(fault)
    return out


def every_repair(rows, faults):
    """(cost, audit, lines) of all edits of a short conversation, tried out one by one; two insertions at most in one place."""
    accepted = re.compile("(s?(ua)+)?")
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = []
    for (_, role, text), fault in zip(rows, faults):
        gone = (2, "D", None)
        late = 5 if fault == "truncated" else 0
        stay = [(late, "K", (role, text)), (late + 1, "R", ("user", text)), (late + 1, "R", ("assistant", text))]
        choices.append([gone] if fault in ("blank", "duplicate") else [gone, *stay])
    for edits in itertools.product(*choices):
        for more in itertools.product(inserts, repeat=len(rows) + 1):
            lines, audit, cost = [], "", 0
            for k, extra in enumerate(more):
                lines += [(r, "") for r in extra]
                audit, cost = audit + "I" * len(extra), cost + 5 * len(extra)
                if k < len(edits):
                    cost, audit = cost + edits[k][0], audit + edits[k][1]
                    lines += [edits[k][2]] if edits[k][2] else []
            if accepted.fullmatch("".join(r[:1] for r, _ in lines)):
                yield cost, audit, lines


def plain_repair(rows):
    faults = plain_faults(rows)
    cost, audit, lines = min(every_repair(rows, faults), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def query(spark, rows):
    given = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3)
    told = repair.told(given)
    return {r[0]: tuple(r)[1:] for r in repair.repair(repair.damaged(told), told.select("cid", "conv_id")).collect()}


@pytest.mark.parametrize("block", [2, 256])
def test_repair_against_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for conv in [None, *range(60)]:
        for turn in rng.sample([None, *range(9)], rng.randint(1, 3)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["Yes.", "Yes.", "no", "", " \n", None, "Well! \t", "a.b"])))
    got = query(spark, rows)
    want = {c: plain_repair(x) for c, x in plain_damage(rows).items()}
    assert got == want
    assert repair.repaired(repair.told(spark.createDataFrame([], SCHEMA)), repair.told(spark.createDataFrame([], SCHEMA))).count() == 0


def long_repair(rows):
    """The same by a table over rows and states, for long conversations."""
    now = {"": (0, "", ())}

    def put(new, state, cost, audit, way):
        if state not in new or (cost, audit) < new[state][:2]:
            new[state] = (cost, audit, way)

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, a, w) in list(out.items()):
                role, to = ("assistant", "a") if s == "u" else ("user", "u")
                put(out, to, c + 5, a + "I", (w, (role, "")))
        return out

    for (_, role, text), fault in zip(rows, plain_faults(rows)):
        new = {}
        for s, (c, a, w) in inserted(now).items():
            put(new, s, c + 2, a + "D", w)
            if fault in ("blank", "duplicate"):
                continue
            late = 5 if fault == "truncated" else 0
            ways = [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]
            for letter, r, cost in ways:
                if r[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[s]:
                    put(new, r[:1], c + late + cost, a + letter, (w, (r, text)))
        now = new
    cost, audit, way = min(x for s, x in inserted(now).items() if s in ("", "a"))
    lines = []
    while way:
        way, line = way
        lines.append(line)
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in reversed(lines)).encode()).hexdigest()


def test_long_conversation_over_many_blocks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 16)
    rng = random.Random(4)
    texts = ["Same text.", *(f"Text {k}." for k in range(40)), *(f"open {k}" for k in range(40)), ""]
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(texts)) for t in range(900) if t % 11]
    rows += rows[5:9] + [(8, t, "user", "Same text.") for t in range(300)] + [(9, 2**62, "user", "x" * 300_000 + "."), (9, -(2**62) - 2, "assistant", "é.")]
    got = query(spark, rows)
    for conv, x in plain_damage(rows).items():
        faults, turns = plain_faults(x), {r[0] for r in x}
        gaps = max(turns) - min(turns) + 1 - len(turns)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(x, x[1:]))
        assert got[conv] == (gaps if gaps < 2**63 else None, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *long_repair(x))


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 0, "assistant", "A.")]
    told = repair.told(spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA))
    got = repair.repaired(told, told.select("cid", "conv_id")).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Again.")]


# quality


def plain_statistics(text: bytes) -> dict:
    kind = lambda c: next(k for k, v in {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "newline": [10], "blank": [32, 9, 11, 12, 13], "stop": b".!?", "comma": b",;:'\"()-", "wide": range(128, 256), "symbol": range(256)}.items() if c in v)
    kinds, words = [kind(c) for c in text], text.split()
    n, m = max(1, len(text)), max(1, len(words))
    size = [min(len(w), 64) for w in words]
    mean = sum(size) / m
    lines, pairs = text.split(b"\n"), list(zip(words, words[1:]))
    entropy = -sum(c / n * np.log2(c / n) for c in (text.count(bytes([b])) for b in set(text)))
    out = {k: kinds.count(k) / n for k in quality.KINDS}
    out |= {"chars": np.log1p(len(text)) / 2, "words": np.log1p(len(words)) / 2, "lines": np.log1p(text.count(b"\n")) / 2, "word_mean": mean / 4, "word_spread": max(0, sum(s * s for s in size) / m - mean**2) ** 0.5 / 4}
    out |= {"word_short": sum(len(w) <= 3 for w in words) / m, "word_long": sum(len(w) > 15 for w in words) / m, "starts_upper": sum(kind(w[0]) == "upper" for w in words) / m, "starts_symbol": sum(kind(w[0]) == "symbol" for w in words) / m}
    out |= {"ends_stop": sum(kind(w[-1]) == "stop" for w in words) / m, "ends_symbol": sum(kind(w[-1]) == "symbol" for w in words) / m, "per_stop": np.log1p(len(words) / (1 + kinds.count("stop"))), "line_mean": np.log1p(len(text) / len(lines)) / 2}
    some = bool(words)
    return out | {"distinct": len(set(words)) / m, "distinct_pairs": (len(set(pairs)) / len(pairs) if pairs else 1) if some else 0, "distinct_lines": len(set(lines)) / len(lines) if some else 0, "entropy": entropy / 4 if some else 0}


def test_statistics_against_loop():
    texts = [b"", b" ", b"One two two. Three!\nOne two\n\n", "été $$ 12|3 (x) ABC".encode(), b"x", b"a b a b a b", b"w" * 100 + b"\t\r\nz"]
    got = quality.statistics(texts)
    for row, t in zip(got, texts):
        want = plain_statistics(t)
        assert np.abs(row / quality.STATISTIC - np.array([want[k] for k in quality.STATISTICS])).max() < 2 / quality.STATISTIC
        assert (quality.statistics([t])[0] == row).all()


def test_isotonic_against_all_means():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    knots, levels = quality.isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all()
    at = np.unique(x)
    mean = lambda a, b: y[(x >= at[a]) & (x <= at[b])].mean()
    want = [max(min(mean(a, b) for b in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]  # the min-max formula
    assert np.allclose(levels, np.unique(np.round(want, 12)))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    rows, labels = [], []
    for k in range(500):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randint(5, 60))]
        text = " ".join(w.capitalize() + "." if i % 7 == 0 else w for i, w in enumerate(words)) if good else " | ".join(w + rng.choice(["$$", "##", ""]) for w in words)
        rows.append((k, text, "en", "s", 1, 1, ""))
        labels.append((k, int(good), 0))
    return rows, labels


def test_quality_separates_and_partitions_change_nothing(spark, judged):
    rows, labels = judged
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    odd = [(None, None, None, None, None, None, None), (None, "x", "", "", 1, 1, ""), (3, "again", "", "", 1, 1, ""), (900, "", "", "", 1, 1, ""), (901, "y" * 200_000, "", "", 1, 1, "")]
    one = quality.quality(frame(spark, rows + odd).repartition(1), lab).collect()
    two = quality.quality(frame(spark, odd + rows).repartition(7, "row", "text"), lab.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.score)
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str) and len(one) == len(rows) + len(odd)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in one if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in one)
    assert [r.score for r in sorted(one, key=key) if r.doc_id == 900][0] is not None


def test_quality_without_labels_or_rows(spark, judged):
    rows, _ = judged
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality(frame(spark, rows[:5]), none).collect()} == {0.0}
    same = spark.createDataFrame([(k, 1, 0) for k in range(500)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality(frame(spark, rows[:50]), same).collect()} == {1.0}
    assert quality.quality(frame(spark, []), none).count() == 0


# source divergence


def plain_divergence(rows):
    docs = [(lang or "", source or "", [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        terms = sorted({w for d in mine for w in d[2] if sum(w in e[2] for e in mine) >= 3})
        count = {s: [sum(d[2].count(w) for d in mine if d[1] == s) for w in terms] for s in {d[1] for d in mine}}
        prob = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(terms)) for x in c]
        p = {s: prob(c) for s, c in count.items()}
        whole = prob([sum(x) for x in zip(*count.values())])
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in p if o != s]
            best = [(f(a, b), w) for a, b, w, n in zip(p[s], whole, terms, count[s]) if n and a > b]
            for part, found, most in (("pair", pairs, None), ("term", best, divergence.TOP)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def divergence_rows(n=260):
    rng = random.Random(9)
    vocabulary = ["the", "The", "été", "Été", "ß", "日本", "x1y", "a-b", "\U0001f600", "ﬀ"] + [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    rows = [(None, None, None), ("", "", ""), (None, "s", "the the"), ("zz", "only", "rare"), ("zz", "other", None), ("yy", "s0", "word word word")] + [("yy", "s0", "word é")] * 2
    for _ in range(n):
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "S", "é", None]), " ".join(rng.choice(vocabulary[rng.randint(0, 40) :]) for _ in range(rng.randint(0, 12)))))
    return rows + rows[20:40]


@pytest.mark.parametrize("held, cells, sums, top", [(400_000, 1 << 20, 1 << 23, 200), (50, 16, 8, 5)])
def test_divergence_against_loop(spark, monkeypatch, held, cells, sums, top):
    for name, value in (("HELD", held), ("CELLS", cells), ("SUMS", sums), ("TOP", top)):
        monkeypatch.setattr(divergence, name, value)
    rows = divergence_rows()
    docs = spark.createDataFrame([(None if k % 5 else k, s, x, t, 1) for k, (x, s, t) in enumerate(rows)], "doc_id long, source string, lang string, text string, term int").repartition(4)
    assert {tuple(r) for r in in_process(docs)} == plain_divergence(rows)


def in_process(docs):
    """source_divergence's rows; the scans run here, so that the patched bounds hold for them too."""
    spark = docs.sparkSession
    import pyarrow as pa

    plain = divergence.by_batches

    def here(df, run, schema):
        table = df.coalesce(1).toArrow()
        batches = list(run(iter(table.to_batches(max_chunksize=50))))
        return spark.createDataFrame(pa.Table.from_batches(batches)) if batches else spark.createDataFrame([], schema)

    divergence.by_batches = here
    try:
        return divergence.source_divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()
    finally:
        divergence.by_batches = plain


def test_divergence_on_spark(spark):
    rows = divergence_rows(120)
    docs = spark.createDataFrame([(x, s, t) for x, s, t in rows], "lang string, source string, text string")
    assert {tuple(r) for r in divergence.source_divergence(docs.repartition(5)).collect()} == plain_divergence(rows)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_per_billion_does_not_overflow():
    x = np.array([1, 2**52, 3 * 10**14, 9 * 10**14], np.int64)
    of = np.array([9 * 10**14, 2**52, 9 * 10**14 - 1, 9 * 10**14], np.int64)
    assert divergence.per_billion(x, of).tolist() == [10**9 * int(a) // int(b) for a, b in zip(x, of)]
