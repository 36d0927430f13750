import hashlib
import random
import re
from collections import Counter, defaultdict

from corvid.llm.substring_dedup import level_lengths, substring_dedup
from corvid.llm.suffix_dedup import suffix_array, suffix_dedup
from tests.llm.cases import frame, tricky

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, n=13):
    first = {}
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1 if d is not None else 0):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - n + 1 if d is not None else 0):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def brute_bytes(rows, n=200):
    seen = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def test_levels():
    assert level_lengths(7, 13) == [7, 13] and level_lengths(3, 13) == [3, 6, 12, 13] and level_lengths(20, 13) == [13]


def test_words_against_brute_force(spark):
    rows = tricky()
    for seed_words in (7, 3):
        assert Counter(map(tuple, substring_dedup(frame(spark), seed_words=seed_words).collect())) == brute_words(rows)


def test_empty(spark):
    assert substring_dedup(frame(spark, [])).count() == 0 and suffix_dedup(frame(spark, [])).count() == 0


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(3000):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 30))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_bytes_against_brute_force(spark):
    for seed in (5, 6):
        rows = tricky(seed)
        for hot in (4000, 3, 1):  # with and without anchors that count as hot
            assert Counter(map(tuple, suffix_dedup(frame(spark, rows), digest=True, hot=hot).collect())) == brute_bytes(rows)


def test_passage_in_many_surroundings(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    passage = word(330)
    rows = [(k, word(rng.randint(0, 120)) + passage + word(rng.randint(0, 120)), None, None, None, 1, "") for k in range(60)]
    assert Counter(map(tuple, suffix_dedup(frame(spark, rows), digest=True, hot=20).collect())) == brute_bytes(rows)


def test_kept_bytes(spark):
    rows = [(1, "x" * 10 + "".join(map(chr, range(200, 420))), None, None, None, 1, ""), (2, "".join(map(chr, range(200, 420))), None, None, None, 1, "")]
    assert {bytes(r.kept) for r in suffix_dedup(frame(spark, rows)).collect()} == {b"x" * 10, b""}
