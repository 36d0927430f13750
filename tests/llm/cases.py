"""Small tables with the cases that every operator has to stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, hits string"


def tricky(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(60)
    texts = [None, "", "   ", "x", base, base, base, base.replace("a", "A", 3), text(80) + "\n" + passage + " " + text(30), passage, text(5) + " " + passage]
    texts += ["é " * 400, "é " * 300, "ab" * 600, "ab" * 150 + "\x00" + "ab" * 120, text(3000) + " " + base, text(13), " ".join(["q"] * 300)]
    words = base.split()
    for k in (3, 40, 90):
        near = list(words)
        near[k] = "changed"
        texts.append(" ".join(near))
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, base), (None, base), (None, None), (30, "a b"), (31, "a  b"), (32, "A B")]
    return [(d, t, "en", "s", None if t is None else len(t), 7, "clash") for d, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(tricky() if rows is None else rows, DOCS)
