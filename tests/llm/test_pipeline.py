"""The pipeline against a brute-force version of each stage, on its own input."""

import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corvid.llm.decontaminate import normal
from corvid.llm.toxicity import toxicity
from tests.llm.test_minhash import brute as near_copies
from tests.llm.test_pages_and_benchmark import distance
from tests.llm.test_substring_and_suffix import brute_words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"w{k}x" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, item = text(40), text(30)
    docs, toxic = [], []
    for k in range(400):
        words = text(rng.randint(20, 120))
        bad = rng.random() < 0.25
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty"])
        elif k % 9 == 0:
            words += passage
        elif k % 31 == 0:
            words[5:5] = item
        docs.append((k, " ".join(words), "en", f"s{k % 3}"))
        toxic.append((k, 1, int(bad)))
    for k in range(400, 430):
        words = docs[k - 390][1].split()
        words[rng.randrange(len(words))] = "changed"
        docs.append((k, " ".join(words), "en", "s"))
    docs += [(900, None, None, "s"), (901, "", "en", "s"), (902, docs[50][1], "en", "s")]
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    columns = docs.columns
    rejected = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert 60 < len(rejected) < 160
    want = [r for r in rows if r[0] not in rejected]
    frame = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, folder)
        if name == "minhash near-dedup":
            kept = {d for d, _, _, keep in near_copies(want) if keep}
            assert len(kept) < len(want)
            want = [r for r in want if r[0] in kept]
        elif name == "substring dedup":
            cut = {d: (n, t) for d, _, n, t in brute_words(want)}
            assert sum(n for n, _ in cut.values()) > 300
            want = [r if not cut[r[0]][0] else (r[0], cut[r[0]][1], *r[2:4], len(cut[r[0]][1])) for r in want]
        elif name == "benchmark decontamination":
            item = normal(spark.read.parquet(f"{folder}/benchmark.parquet").first().text)
            clean = [r for r in want if not r[1] or distance(item, normal(r[1])) > len(item.strip()) // 12]
            assert len(clean) < len(want)
            want = clean
        if k + 1 < len(corpus_pipeline.STAGES):
            assert frame.columns == columns and Counter(map(tuple, frame.collect())) == Counter(want)
    check_packed(frame.collect(), want)


def check_packed(pieces, docs):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: [*slow.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in docs}
    seen, place = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
        seen[p.doc_id].append((p.start, p.length))
        place[p.sequence_id].append((p.offset, p.length))
    assert seen.keys() == ids.keys() and all(sum(n for _, n in s) == len(ids[d]) for d, s in seen.items())
    for spans in (*seen.values(), *place.values()):
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n


def test_run(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark, folder):
    """Empty tables, repeated and missing ids, clashing names, a very long text: every stage stands them."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(5000)) for _ in range(150_000))
    kind = "doc_id long, text string, n_chars long, n_shingles long, component_id long, kept boolean, key long, hits string, score double, ids string, row long, rest string, _once int, label int"
    clash = (5, 6, True, 7, "h", 0.5, "i", 8, "r", 9, 1)
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "another text of seven words is here"), (None, "no id at all"), (None, None), (2, None), (3, ""), (4, long), (5, "one two three four five six")]
    docs = spark.createDataFrame([(d, t, None if t is None else len(t), *clash) for d, t in texts], kind)
    frame, empty = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame, empty = stage(spark, frame, folder), stage(spark, empty, folder)
        assert frame.schema == docs.schema == empty.schema and empty.count() == 0
        got = Counter((r.doc_id, r.text) for r in frame.collect())
        want = Counter(texts)
        if name != "toxicity":
            want -= Counter([texts[0], texts[-1]])
        assert got == want
        assert all(tuple(r)[3:] == clash for r in frame.collect())
    packed = corpus_pipeline.packing(spark, frame, folder)
    assert {r.doc_id for r in packed.collect()} == {None, 1, 2, 3, 4} and corpus_pipeline.packing(spark, empty, folder).count() == 0


def test_scratch_tables_go(spark, folder):
    from corvid.llm.common import own_scratch, scratch, stash, sweep

    before = scratch()
    with own_scratch() as mine:
        made = stash(spark.range(3).toDF("a"), "mine")
        with ThreadPoolExecutor(1) as other:  # another thread's run keeps its own
            theirs = other.submit(lambda: stash(spark.range(2).toDF("a"), "theirs")).result()
    assert made.count() == 3 and mine == {made.scratch} and scratch() == before | {made.scratch, theirs.scratch}
    sweep(spark, mine)
    assert scratch() == before | {theirs.scratch} and theirs.count() == 2
    sweep(spark, [theirs.scratch])


def test_local_session_without_a_shared_folder(tmp_path):
    code = (
        "from pyspark.sql import SparkSession; from corvid.llm.common import shared_dir, stash\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert stash(spark.range(3).toDF('a'), 't').count() == 3 and shared_dir(spark) == shared_dir(spark.newSession())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env={**os.environ, "PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)})
