"""Ranking metrics (textbook definitions) and parameter search, many points in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.analysis.analyzer import Analyzer
from corvid.operators import bags, fusion
from corvid.operators.index import Index
from corvid.operators.sampler import sample
from corvid.operators.scoring import bm25_idf, bm25_weight, exact_sum, query_terms, scored_postings

METRICS = ("hits", "hit_rate", "precision", "recall", "f1", "r_precision", "mrr", "map", "dcg", "ndcg")


@dataclass(frozen=True)
class Judged:
    """Judgements as a table: q_id, doc_id, rel."""

    pairs: DataFrame

    def grades(self) -> DataFrame:
        """(q_id, rel, n): how many relevant documents of each grade a query has."""
        return self.pairs.where("rel > 0").groupBy("q_id", "rel").agg(F.count("*").alias("n"))

    def of(self, run: DataFrame) -> DataFrame:
        """The run with the grades of its documents; null where there is none above 0."""
        return run.join(self.pairs.where("rel > 0").select("q_id", "doc_id", "rel"), ["q_id", "doc_id"], "left")


@dataclass(frozen=True)
class SharedLabel:
    """A document of a query's label is relevant to it, with the document's own grade, and the query itself is not. The pairs, whose
    number grows with the square of the documents, are never made. docs: doc_id, label, rel. queries: q_id, label."""

    docs: DataFrame
    queries: DataFrame

    def grades(self) -> DataFrame:
        good = self.docs.where("rel > 0")
        shared = self.queries.join(good.groupBy("label", "rel").agg(F.count("*").alias("n")), "label").select("q_id", "rel", "n")
        own = self.queries.join(good, (F.col("doc_id") == F.col("q_id")) & (good["label"] == self.queries["label"])).select("q_id", "rel", F.lit(-1).cast("long").alias("n"))
        return shared.union(own).groupBy("q_id", "rel").agg(F.sum("n").alias("n")).where("n > 0")

    def of(self, run: DataFrame) -> DataFrame:
        asked = self.queries.select("q_id", F.col("label").alias("q_label"))
        told = run.join(asked, "q_id", "left").join(self.docs.select("doc_id", "label", F.col("rel").alias("grade")), "doc_id", "left")
        same = (F.col("q_label") == F.col("label")) & (F.col("doc_id") != F.col("q_id")) & (F.col("grade") > 0)
        return told.withColumn("rel", F.when(same, F.col("grade"))).drop("q_label", "label", "grade")


#: Places of one grade whose gains are summed as one row.
PLACES = 1024


def _want(grades: DataFrame, k: int | None) -> DataFrame:
    """(q_id, n_rel, ideal) of grades: the best order puts higher grades first, so each takes the places behind those above it."""
    above = Window.partitionBy("q_id").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, -1)
    rows = grades.withColumn("first", F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).withColumn("end", F.col("first") + F.col("n") - 1)
    rows = rows if k is None else rows.withColumn("end", F.least("end", F.lit(k)))
    n_rel = rows.groupBy("q_id").agg(F.sum("n").alias("n_rel"))
    parts = rows.where("first <= end").select("q_id", "rel", "end", F.explode(F.sequence("first", "end", F.lit(PLACES).cast("long"))).alias("a"))
    places = F.sequence("a", F.least(F.col("a") + PLACES - 1, F.col("end")))
    units = F.aggregate(places, F.lit(0).cast("long"), lambda s, p: s + F.floor(F.col("rel") / F.log2(p + 1) * 1e10 + 0.5))
    ideal = parts.groupBy("q_id").agg((F.floor(F.sum(units) / 1e4 + 0.5) / 1e6).alias("ideal"))
    return n_rel.join(ideal, "q_id")


def per_query(run: DataFrame, qrels: DataFrame | Judged | SharedLabel, metric: str, k: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, q_id, value) for every query with a relevant document. run: keys, q_id, doc_id, rank. qrels: q_id, doc_id, rel, or what
    tells grades otherwise (`SharedLabel`).

    precision divides by k (or by what was returned); dcg's gain is rel over log2(rank + 1).
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    told = Judged(qrels) if isinstance(qrels, DataFrame) else qrels
    gain = lambda rel, rank: rel / F.log2(rank + 1)
    want = _want(told.grades(), k)
    judged = told.of(run if k is None else run.where(F.col("rank") <= k)).join(want, "q_id")
    hit = F.col("rel").isNotNull()
    seen = Window.partitionBy(*keys, "q_id").orderBy("rank")
    judged = judged.withColumn("so_far", F.sum(hit.cast("int")).over(seen))
    agg = judged.groupBy(*keys, "q_id").agg(
        F.first("n_rel").alias("n_rel"), F.first("ideal").alias("ideal"), F.count("*").alias("returned"), F.count_if(hit).alias("hits"),
        F.count_if(hit & (F.col("rank") <= F.col("n_rel"))).alias("early"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        exact_sum(F.when(hit, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"), exact_sum(F.when(hit, gain(F.col("rel"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    hits, p, r = F.col("hits"), F.col("hits") / (F.lit(k) if k else F.col("returned")), F.col("hits") / F.col("n_rel")
    value: dict[str, Column] = {
        "hits": hits.cast("double"), "hit_rate": (hits > 0).cast("double"), "precision": p, "recall": r, "f1": F.when(hits > 0, 2 * p * r / (p + r)).otherwise(0.0), "r_precision": F.col("early") / F.col("n_rel"),
        "mrr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "map": F.col("ap") / F.col("n_rel"), "dcg": F.col("dcg"), "ndcg": F.col("dcg") / F.col("ideal"),
    }
    scored = agg.select(*keys, "q_id", value[metric].alias("value"))
    if keys:
        return scored
    return want.select("q_id").join(scored, "q_id", "left").select("q_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def evaluate(run: DataFrame, qrels: DataFrame | Judged | SharedLabel, metric: str = "ndcg", k: int | None = None) -> DataFrame:
    """One row: the mean over the queries that have a relevant document; queries without results count as 0."""
    if "@" in metric:
        metric, cut = metric.split("@")
        k = int(cut)
    return per_query(run, qrels, metric, k).agg(F.round(F.avg(F.col("value").cast("decimal(20,10)")).cast("double"), 6).alias("value"))


def _mean_by(run: DataFrame, qrels: DataFrame, metric: str, keys: tuple[str, ...]) -> DataFrame:
    name, _, cut = metric.partition("@")
    values = per_query(run, qrels, name, int(cut) if cut else None, keys)
    told = Judged(qrels) if isinstance(qrels, DataFrame) else qrels
    asked = told.grades().agg(F.countDistinct("q_id").alias("asked"))
    return values.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(20,10)")).alias("s")).join(F.broadcast(asked)).select(*keys, F.round(F.col("s").cast("double") / F.col("asked"), 6).alias("value"))


#: Points that one aggregation sums beside each other; more make more columns than generated code takes.
BATCH = 24


def _judged(wide: DataFrame, points: list[tuple], names: tuple[str, ...], qrels: DataFrame, metric: str, cutoff: int) -> DataFrame:
    """(names, value) of points whose scores stand beside each other in wide (q_id, doc_id, s0, s1, ...)."""
    return _best_judged(wide.select("q_id", "doc_id", F.posexplode(F.array(*(f"s{k}" for k in range(len(points))))).alias("p", "score")), points, names, qrels, metric, cutoff)


def _best_judged(scores: DataFrame, points: list[tuple], names: tuple[str, ...], qrels: DataFrame, metric: str, cutoff: int) -> DataFrame:
    """The same of scores (p, q_id, doc_id, score)."""
    best = Window.partitionBy("p", "q_id").orderBy(F.desc("score"), "doc_id")
    run = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cutoff)
    told = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, x))) for x in points))
    return _mean_by(run, qrels, metric, ("p",)).withColumn("x", told[F.col("p")]).select(*(f"x.{n}" for n in names), "value")


def judge_bm25(index: Index, queries: DataFrame, qrels: DataFrame, analyzer: Analyzer, points: list[tuple[float, float]], metric: str = "ndcg", cutoff: int = 100) -> DataFrame:
    """(b, k1, value) of some points: each posting is weighted for all of them, and a document's sums are one row."""
    hits = scored_postings(index, query_terms(queries, analyzer)) if index.bags is None else None
    parts = []
    for a in range(0, len(points), BATCH):
        some = points[a : a + BATCH]
        if hits is None:
            scores = bags.ranked(index.bags, query_terms(queries, analyzer), [(float(b), float(k1)) for b, k1 in some], bm25_idf(), cutoff)
            parts.append(_best_judged(scores, some, ("b", "k1"), qrels, metric, cutoff))
            continue
        wide = hits.groupBy("q_id", "doc_id").agg(*(exact_sum(F.col("qtf") * bm25_weight(b, k1)).alias(f"s{k}") for k, (b, k1) in enumerate(some)))
        parts.append(_judged(wide, some, ("b", "k1"), qrels, metric, cutoff))
    return reduce(DataFrame.unionByName, parts)


def tune_bm25(index: Index, queries: DataFrame, qrels: DataFrame, analyzer: Analyzer, metric: str = "ndcg", bs: list[float] | None = None, k1s: list[float] | None = None, cutoff: int = 100) -> DataFrame:
    """(b, k1, value) of every point of a grid, best first."""
    points = list(product(bs or [x / 10 for x in range(11)], k1s or [x / 2 for x in range(21)]))
    return judge_bm25(index, queries, qrels, analyzer, points, metric, cutoff).orderBy(F.desc("value"), "b", "k1")


def sample_bm25(index: Index, queries: DataFrame, qrels: DataFrame, analyzer: Analyzer, metric: str = "ndcg", trials: int = 100, seed: int = 42, cutoff: int = 100) -> list[tuple[dict, float]]:
    """The trials of a seeded sampler over b in steps of .01 and k1 in steps of .1, best first; runs a job for each batch."""

    def judge(points: list[dict]) -> list[float]:
        told = judge_bm25(index, queries, qrels, analyzer, [(p["b"], p["k1"]) for p in points], metric, cutoff).collect()
        value = {(r.b, r.k1): r.value for r in told}
        return [value.get((p["b"], p["k1"])) or 0.0 for p in points]

    return sample({"b": [x / 100 for x in range(101)], "k1": [x / 10 for x in range(101)]}, judge, trials, seed)


def judge_fusion(runs: list[DataFrame], qrels: DataFrame, points: list[tuple[str, float]], metric: str = "ndcg", cutoff: int = 100) -> DataFrame:
    """(norm, weight, value) of some points. Each run is normalised once, in all ways that the points name beside each other."""
    norms = sorted({n for n, _ in points})
    column = {n: f"n{k}" for k, n in enumerate(norms)}
    each = [r.select("q_id", "doc_id", "score").withColumns({column[n]: fusion.normalized_score(n, ["q_id"]) for n in norms}).drop("score").withColumn("part", F.lit(k)) for k, r in enumerate(runs)]
    both = reduce(DataFrame.unionByName, each)
    parts = []
    for a in range(0, len(points), BATCH):
        some = points[a : a + BATCH]
        share = lambda w: F.when(F.col("part") == 0, F.lit(w)).otherwise(1 - F.lit(w))
        wide = both.groupBy("q_id", "doc_id").agg(*(exact_sum(F.col(column[n]) * share(w)).alias(f"s{k}") for k, (n, w) in enumerate(some)))
        parts.append(_judged(wide, some, ("norm", "weight"), qrels, metric, cutoff))
    return reduce(DataFrame.unionByName, parts)


NORMS = ("min-max", "max", "sum")


def tune_fusion(runs: list[DataFrame], qrels: DataFrame, metric: str = "ndcg", norms: tuple[str, ...] = NORMS, weights: list[float] | None = None, cutoff: int = 100) -> DataFrame:
    """(norm, weight, value): of two runs, the first weighs `weight` and the second the rest; best first."""
    points = list(product(norms, weights or [x / 10 for x in range(11)]))
    return judge_fusion(runs, qrels, points, metric, cutoff).orderBy(F.desc("value"), "norm", "weight")


def sample_fusion(runs: list[DataFrame], qrels: DataFrame, metric: str = "ndcg", trials: int = 60, seed: int = 42, cutoff: int = 100) -> list[tuple[dict, float]]:
    """The trials of a seeded sampler over the normalisations and weights in steps of .01, best first."""

    def judge(points: list[dict]) -> list[float]:
        told = judge_fusion(runs, qrels, [(p["norm"], p["weight"]) for p in points], metric, cutoff).collect()
        value = {(r.norm, r.weight): r.value for r in told}
        return [value.get((p["norm"], p["weight"])) or 0.0 for p in points]

    return sample({"norm": NORMS, "weight": [x / 100 for x in range(101)]}, judge, trials, seed)
