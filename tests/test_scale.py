"""What must not grow with the square of the documents, against the plain forms."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.analysis.analyzer import Analyzer
from corvid.operators import bags, evaluation, scoring
from corvid.operators.best import Best
from corvid.operators.dense import exact_top_k
from corvid.operators.index import build_index


@pytest.mark.parametrize("metric", ["hits@3", "recall", "r_precision", "map", "ndcg@3", "ndcg", "mrr"])
def test_shared_labels_judge_like_their_pairs(spark, metric):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, rng.choice([1, 2, 3, None]), rng.randrange(3)) for k in range(60)], "doc_id long, label int, rel int")
    asked = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("q_id"), "label")
    pairs = docs.join(asked, "label").where("doc_id <> q_id").select("q_id", "doc_id", "rel")
    run = spark.createDataFrame([(q, d, k + 1) for q in range(0, 60, 5) for k, d in enumerate(rng.sample(range(70), 10))], "q_id long, doc_id long, rank int")
    name, _, k = metric.partition("@")
    told = [sorted(map(tuple, evaluation.per_query(run, q, name, int(k) if k else None).collect())) for q in (pairs, evaluation.SharedLabel(docs, asked))]
    assert told[0] == told[1] and len(told[0]) > 5


def test_a_task_keeps_k_candidates_for_each_query(spark):
    rng = np.random.default_rng(3)
    best, scores, ids = Best(5, 4), np.round(rng.random((5, 900)), 1), rng.permutation(900)
    best.most = 50
    for a in range(0, 900, 90):
        best.offer(0, scores[:2, a : a + 90], ids[a : a + 90])
        best.offer(2, scores[2:, a : a + 90], ids[a : a + 90])
    q, doc, score = best.compact()
    want = [(k, int(i), s) for k in range(5) for s, i in sorted(zip(scores[k], ids), key=lambda x: (-x[0], x[1]))[:4]]
    assert list(zip(q.tolist(), doc.tolist(), score.tolist())) == want and best.held == 20
    # many batches, one task: what leaves it is k rows for each query
    docs = spark.range(30_000, numPartitions=1).select(F.format_string("d%05d", "id").alias("doc_id"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("vector"))
    run = exact_top_k(docs.repartition(16), docs.limit(3).withColumnRenamed("doc_id", "q_id"), 5)
    assert {r.doc_id for r in run.where("q_id = 'd00001'").collect()} == {f"d{k:05d}" for k in (6, 13, 20, 27, 34)}
    assert docs.repartition(64).rdd.getNumPartitions() == 64 and "Coalesce" in run._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("model, operator", [("bm25", "OR"), ("tf-idf", "OR"), ("bm25", "AND")])
def test_streamed_ranking_equals_postings(spark, monkeypatch, model, operator):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("the of and".split() * 3 + [f"w{rng.randrange(60)}"]) for _ in range(n))
    docs = spark.createDataFrame([(k, None if k == 7 else text(rng.randrange(40))) for k in range(300)], "doc_id long, text string")
    asked = docs.where("doc_id % 4 = 0").select(F.format_string("q%d", "doc_id").alias("q_id"), F.concat_ws(" ", "text", F.lit("zzz the")).alias("text"))
    for name, value in (("CELLS", 1 << 10), ("HELD", 64), ("KEPT", 200)):
        monkeypatch.setattr(bags, name, value)
    index = build_index(docs)
    got, want = (scoring.search(i, asked, Analyzer(), model, cutoff=9, operator=operator, subset=docs.where("doc_id <> 5").select("doc_id")) for i in (index, replace(index, bags=None)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "MapInArrow" in str(got._jdf.queryExecution().executedPlan())


def test_streamed_ranking_has_a_task_per_core(spark):
    # each task hands on k candidates of every query, so a task per split handed on more with every split
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("all"), F.format_string("w%d", F.col("id") % 50)).alias("text")).repartition(96)
    index, asked = build_index(docs), scoring.query_terms(docs.where("doc_id < 20").select(F.col("doc_id").alias("q_id"), "text"), Analyzer())
    rows = bags.ranked(index.bags, asked, [(0.75, 1.2)], scoring.bm25_idf(), 3)
    assert index.bags.rdd.getNumPartitions() == 96 and rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert {r.q_id: r.doc_id for r in scoring.top_k(rows, 1).collect()} == {k: k for k in range(20)}
    # documents that are met stay with sums of zero, and no others do
    none = bags.ranked(index.bags, asked.where("term <> 'all'"), [(0.75, 1.2)], F.lit(1e-12), 400).collect()
    assert {(r.q_id, r.doc_id, r.score) for r in none} == {(q, d, 0.0) for q in range(20) for d in range(q, 400, 50)}
