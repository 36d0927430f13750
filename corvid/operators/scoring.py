"""BM25 and TF-IDF ranking of many queries in one plan."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.analysis.analyzer import Analyzer
from corvid.operators.index import Index


#: So many distinct terms of queries are looked for by a filter on the postings; more by a join.
FEW_TERMS = 100


def query_terms(queries: DataFrame, analyzer: Analyzer, id_col: str = "q_id", text_col: str = "text") -> DataFrame:
    """(q_id, term, qtf): a term that a query repeats counts as often."""
    return analyzer.terms(queries, id_col, text_col).withColumnRenamed(id_col, "q_id").groupBy("q_id", "term").agg(F.count("*").alias("qtf"))


def bm25_idf() -> Column:
    return F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def tf_idf_idf() -> Column:
    return F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1


def bm25_weight(b: float | Column = 0.75, k1: float | Column = 1.2) -> Column:
    b, k1 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (b, k1))
    return bm25_idf() * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("rel_len")))


def tf_idf_weight() -> Column:
    return F.col("tf") / F.col("doc_len") * tf_idf_idf()


def exact_sum(c: Column) -> Column:
    """Sum in fixed point (1e-10, given to 1e-6): neither the order of rows nor the number of tasks changes a digit.

    64-bit integers hold sums up to 9e8; decimals of this width would leave generated code's fast path.
    """
    return F.floor(F.sum(F.floor(c * 1e10 + 0.5)) / 1e4 + 0.5) / 1e6


def scored_postings(index: Index, terms: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """The postings of the queries' terms, with what the weights need. Terms outside the vocabulary fall away.

    within (q_id, doc_id, block): only these documents, for a written index by whole lists first.
    """
    wanted = terms.join(index.term_stats, "term")
    if index.lists is not None:  # lists meet the terms whole; a document's length stands beside its count
        lists = index.lists.drop("best").join(wanted, "term")
        if within is not None:
            lists = lists.join(within.select("q_id", "block").distinct(), ["q_id", "block"], "left_semi")
        rows = lists.select("*", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("x"))
        hits = rows.select("term", *(c for c in wanted.columns if c != "term"), "block", F.col("x.docs").alias("doc_id"), F.col("x.tfs").alias("tf"), F.col("x.lens").alias("doc_len"))
        hits = hits.join(F.broadcast(index.totals)).withColumn("rel_len", F.col("doc_len") / F.nullif("avg_len", F.lit(0.0)))
    else:
        hits = index.postings.join(wanted, "term").join(index.doc_stats, "doc_id").join(F.broadcast(index.totals)).withColumn("block", F.lit(0))
    return hits if within is None else hits.join(within.select("q_id", "doc_id"), ["q_id", "doc_id"], "left_semi")


def conjunction(index: Index, terms: DataFrame) -> DataFrame:
    """The postings of documents that the rarest known term of their query has, with `needed`, the number of known terms."""
    by_df = Window.partitionBy("q_id").orderBy("df", "term")
    known = terms.join(index.term_stats, "term").withColumns({"place": F.row_number().over(by_df), "needed": F.count("*").over(Window.partitionBy("q_id"))}).drop("df")
    rarest = scored_postings(index, known.where("place = 1"))
    others = scored_postings(index, known.where("place > 1"), rarest.select("q_id", "doc_id", "block"))
    return rarest.unionByName(others)


def only_terms(index: Index, terms: list[str]) -> Index:
    """The index as far as these terms go; a written one, which lies by term, is read only at their row groups."""
    any_ = reduce(Column.__or__, (F.col("term") == F.lit(t) for t in terms)) if terms else F.lit(False)
    return replace(index, postings=index.postings.where(any_), term_stats=index.term_stats.where(any_), lists=None if index.lists is None else index.lists.where(any_), bags=None)


def few_terms(queries: DataFrame, analyzer: Analyzer) -> list[str] | None:
    """The distinct terms of queries, or None if there are more than `FEW_TERMS`."""
    found = analyzer.terms(queries, "q_id", "text").select("term").distinct().limit(FEW_TERMS + 1).collect()
    return [r.term for r in found] if len(found) <= FEW_TERMS else None


def score(index: Index, terms: DataFrame, weight: Column, operator: str = "OR", subset: DataFrame | None = None) -> DataFrame:
    """(q_id, doc_id, score) of all matching documents.

    operator AND keeps documents with every in-vocabulary term of the query; subset (doc_id) restricts candidates
    before any arithmetic and leaves the statistics alone.
    """
    if operator not in ("OR", "AND"):
        raise ValueError(f"unknown operator {operator!r}")
    hits = scored_postings(index, terms) if operator == "OR" else conjunction(index, terms)
    if subset is not None:
        hits = hits.join(subset, "doc_id", "left_semi")
    total = exact_sum(F.col("qtf") * weight).alias("score")
    if operator == "OR":
        return hits.groupBy("q_id", "doc_id").agg(total)
    return hits.groupBy("q_id", "doc_id", "needed").agg(total, F.count("*").alias("n_terms")).where("n_terms = needed").select("q_id", "doc_id", "score")


def top_k(scores: DataFrame, k: int, group: str = "q_id", item: str = "doc_id", value: str = "score") -> DataFrame:
    """The k best of each group, with their rank; ties go to the smaller id. Limited before and after the exchange."""
    best = Window.partitionBy(group).orderBy(F.desc(value), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, analyzer: Analyzer, model: str = "bm25", b: float = 0.75, k1: float = 1.2, cutoff: int = 100, operator: str = "OR", subset: DataFrame | None = None, prune: bool = False) -> DataFrame:
    """(q_id, doc_id, score, rank). prune: score only what the bounds of a written index leave (`blockmax`); the same rows."""
    if model not in ("bm25", "tf-idf"):
        raise ValueError(f"unknown model {model!r}")
    if prune and index.lists is not None and operator == "OR" and subset is None:
        from corvid.operators.blockmax import pruned_top_k

        return pruned_top_k(index, query_terms(queries, analyzer), cutoff, model, b, k1)
    if index.bags is not None and not queries.isStreaming:
        if operator not in ("OR", "AND"):
            raise ValueError(f"unknown operator {operator!r}")
        from corvid.operators import bags

        point, idf = ((float(b), float(k1)), bm25_idf()) if model == "bm25" else (None, tf_idf_idf())
        return top_k(bags.ranked(index.bags, query_terms(queries, analyzer), [point], idf, cutoff, operator == "AND", subset).drop("p"), cutoff)
    weight = bm25_weight(b, k1) if model == "bm25" else tf_idf_weight()
    return top_k(score(index, query_terms(queries, analyzer), weight, operator, subset), cutoff)


def with_documents(run: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Result rows with the document's columns, in rank order."""
    return run.join(docs.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else docs, "doc_id").orderBy("q_id", "rank")


def batch_results(run: DataFrame, queries: DataFrame, model: str, qrels: DataFrame | None = None) -> DataFrame:
    """One row per query: q_id, text, {model}_doc_ids, {model}_scores, and rel_doc_ids, rel_scores with qrels."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score")))
    lists = run.groupBy("q_id").agg(ranked.alias("r")).select("q_id", F.col("r.doc_id").alias(f"{model}_doc_ids"), F.col("r.score").alias(f"{model}_scores"))
    out = queries.select("q_id", "text").join(lists, "q_id", "left")
    if qrels is not None:
        rel = qrels.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "rel"))).alias("r"))
        out = out.join(rel.select("q_id", F.col("r.doc_id").alias("rel_doc_ids"), F.col("r.rel").alias("rel_scores")), "q_id", "left")
    return out
