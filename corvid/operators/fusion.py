"""Score normalisation and weighted fusion of runs (q_id, doc_id, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.scoring import exact_sum, top_k

TINY = 1e-9
#: How many results of each run are fused; scores are normalised over these.
DEPTH = 1000


def normalized_score(norm: str, keys: list[str]) -> Column:
    """min-max, max or sum normalisation of score within a run's query."""
    w, s = Window.partitionBy(*keys), F.col("score")
    low, high = F.min(s).over(w), F.max(s).over(w)
    if norm == "min-max":
        return (s - low) / F.greatest(high - low, F.lit(TINY))
    if norm == "max":
        return s / F.greatest(high, F.lit(TINY))
    if norm == "sum":
        total = F.sum(s.cast("decimal(20,10)")).over(w).cast("double")
        return (s - low) / F.greatest(total - low * F.count(s).over(w), F.lit(TINY))
    raise ValueError(f"unknown normalisation {norm!r}")


def normalize(run: DataFrame, norm: str = "min-max", keys: list[str] | None = None) -> DataFrame:
    return run.withColumn("score", normalized_score(norm, keys or ["q_id"]))


def fuse(runs: list[DataFrame], norm: str = "min-max", weights: list[float] | None = None, cutoff: int = 100) -> DataFrame:
    """(q_id, doc_id, score, rank): weighted sum of normalised scores; ties go to the smaller id."""
    weights = weights or [1.0] * len(runs)
    parts = [normalize(r.select("q_id", "doc_id", "score"), norm).withColumn("score", F.col("score") * float(w)) for r, w in zip(runs, weights, strict=True)]
    both = reduce(DataFrame.unionByName, parts).groupBy("q_id", "doc_id").agg(exact_sum(F.col("score")).alias("score"))
    return top_k(both, cutoff)
