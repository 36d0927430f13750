import random
import re
from collections import Counter

from corvid.llm.minhash_dedup import minhash_dedup
from tests.llm.cases import frame, tricky

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if None in (a, b) or not s or not t:
                continue
            n = len(s & t)
            if 100 * n >= 75 * (len(s) + len(t) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return Counter((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets)


def test_tricky(spark):
    assert Counter(map(tuple, minhash_dedup(frame(spark)).collect())) == brute(tricky())


def test_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(160)] = f"x{rng.random()}"
        rows.append((k, " ".join(w), None, None, None, 1, ""))
    assert Counter(map(tuple, minhash_dedup(frame(spark, rows)).collect())) == brute(rows)


def test_empty(spark):
    assert minhash_dedup(frame(spark, [])).count() == 0


def test_buckets_over_a_block(spark):
    """Groups of near copies, chains of them, and clouds just under the limit, in buckets of many blocks."""
    rng = random.Random(2)
    rows = []
    for group, (size, edits) in enumerate([(150, 2), (120, 12), (60, 9), (90, 5)]):
        base = [f"g{group}w{k}" for k in range(160)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(160)] = f"x{rng.random()}"
            rows.append(" ".join(w))
        drift = list(base)
        for _ in range(40):  # a chain that leads away from the group
            for _ in range(3):
                drift[rng.randrange(160)] = f"y{rng.random()}"
            rows.append(" ".join(drift))
    rng.shuffle(rows)
    rows = [(k, t, None, None, None, 1, "") for k, t in enumerate(rows)]
    want = brute(rows)
    for block in (16, 64):
        assert Counter(map(tuple, minhash_dedup(frame(spark, rows), block=block).collect())) == want


def test_second_round_compares_all_pairs_of_components(spark):
    from corvid.llm.minhash_dedup import _across

    rows = [(k % 3, k) for k in range(300)] + [(9, 1000), (9, 1001)]
    component = {k: {0: 0, 1: k if k % 7 == 0 else 1, 2: (k % 4) * 3 + 2}[k % 3] for k in range(300)} | {1000: 1000, 1001: 1000}
    found = spark.createDataFrame([(k, c) for k, c in component.items() if k != c], "node long, component long")
    met = _across(spark.createDataFrame(rows, "key long, rep long"), found, 8).collect()
    groups = {}
    for r in met:
        groups.setdefault(r.grp, []).append((r.rep, r.side))
    pairs = {(min(a, b), max(a, b)) for g in groups.values() for a, s in g for b, t in g if a != b and (s == t == 2 or {s, t} == {0, 1})}
    want = {(a, b) for (k, a) in rows for (l, b) in rows if k == l and a < b and component[a] != component[b]}
    assert want <= pairs and len(pairs) < len(want) + 300 * 8
    assert not any(k % 3 == 0 or k >= 1000 for g in groups.values() for k, _ in g)  # one component: nothing to compare
