"""Top-k search that scores only what can be among the best.

A written index keeps its postings in lists: one row for a term in a block of some `BLOCK` documents, with the documents, their
counts of the term and their lengths, and the list's best pairs, those that no other pair of the list beats in both count and length.
From them follows the most that the term can give a document of the block, for any parameters of the model.

A search reads the best pairs alone first and sums, for each query and block, the most that a document there can score. The
best blocks of each query are scored, and their k-th score is a threshold; then only blocks that can beat it are read, and in
these only the postings of documents that can beat it by the terms they have. Each pass is one exchange by block, in which a list
goes once, for however many queries.

Scores are those of `scoring.score`, digit by digit: the same operations in the same order, summed in fixed point.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.index import Index
from corvid.operators.scoring import bm25_idf, tf_idf_idf, top_k

#: Blocks of each query that are scored before there is a threshold: so many, and so many times the blocks that k documents fill.
FIRST = 4
#: What rounding can add to a score.
SLACK = 1e-5
#: Queries whose best scores a task remembers to raise their thresholds.
REMEMBERED = 10_000


def wanted_terms(index: Index, terms: DataFrame, model: str) -> DataFrame:
    """(q_id, term, qtf, idf) of terms that the index has."""
    idf = bm25_idf() if model == "bm25" else tf_idf_idf()
    return terms.join(index.term_stats, "term").join(F.broadcast(index.totals)).select("q_id", "term", F.col("qtf").cast("double").alias("qtf"), idf.alias("idf"))


def _weight(model: str, b: float, k1: float, idf, tf, doc_len, avg_len):
    """The weight of a posting, for columns and for arrays alike, in the order of operations of `scoring`."""
    if model == "tf-idf":
        return tf / doc_len * idf
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * (doc_len / avg_len)))


def block_bounds(index: Index, wanted: DataFrame, model: str, b: float, k1: float) -> DataFrame:
    """(q_id, block, bound): the most that a document of the block can score. Only the best pairs of the lists are read."""
    lists = index.lists.select("term", "block", "best").join(wanted, "term").join(F.broadcast(index.totals.select("avg_len")))
    of = lambda x: _weight(model, b, k1, F.col("idf"), x["tf"], x["doc_len"], F.col("avg_len"))
    most: Column = F.array_max(F.transform("best", of))
    return lists.groupBy("q_id", "block").agg(F.sum(F.col("qtf") * most).alias("bound"))


_ASKED = "array<struct<term string, qtf double, idf double>>"


def _scan(index: Index, asked: DataFrame, requests: DataFrame, model: str, b: float, k1: float, k: int) -> DataFrame:
    """(q_id, doc_id, score, scored): the documents of the requested blocks (q_id, block, threshold) that reach the threshold.

    scored, on one row of each block and query, is how many postings it took.
    """
    kinds = {n: index.lists.schema[n].dataType.simpleString() for n in ("term", "block", "docs", "tfs", "lens")}
    null = lambda kind: F.lit(None).cast(kind)
    q_kind = asked.schema["q_id"].dataType.simpleString()
    # the lists of the queries' terms in the requested blocks, each once
    needed = requests.join(asked.select("q_id", F.explode("terms.term").alias("term")), "q_id").select("block", "term").distinct()
    lists = index.lists.join(needed, ["block", "term"]).join(F.broadcast(index.totals.select("avg_len")))
    best = F.struct(F.col("best.tf").cast("array<double>").alias("tf"), F.col("best.doc_len").cast("array<double>").alias("doc_len"))
    rows = lists.select("block", F.lit(0).alias("kind"), "term", "docs", "tfs", "lens", best.alias("best"), "avg_len", null(q_kind).alias("q_id"), null("double").alias("threshold"), null(_ASKED).alias("terms"))
    best_kind = rows.schema["best"].dataType.simpleString()
    told = requests.join(asked, "q_id").select(
        "block", F.lit(1).alias("kind"), null("string").alias("term"), *(null(kinds[n]).alias(n) for n in ("docs", "tfs", "lens")), null(best_kind).alias("best"), null("double").alias("avg_len"), "q_id", F.col("threshold").cast("double").alias("threshold"), "terms"
    )
    dealt = rows.union(told).repartition("block").sortWithinPartitions("block", "kind")
    doc_kind = index.lists.schema["docs"].dataType.elementType.simpleString()

    def run(batches):
        block, lists, made = None, [], None
        queries: dict = {}  # terms of each query, read once
        best_of: dict = {}  # threshold and best scores of each query
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            blocks, kind, q_ids, lows = (cols[n].to_pylist() for n in ("block", "kind", "q_id", "threshold"))
            out: list[tuple] = []
            for r in range(batch.num_rows):
                if blocks[r] != block:
                    block, lists, made = blocks[r], [], None
                if kind[r] == 0:
                    lists.append((cols["term"][r].as_py(), *(cols[n][r].values for n in ("docs", "tfs", "lens")), cols["best"][r].as_py(), cols["avg_len"][r].as_py()))
                    continue
                if not lists:
                    continue
                if made is None:
                    made = _Block(lists, model, b, k1)
                query = q_ids[r]
                if query not in queries:
                    if len(queries) >= REMEMBERED:
                        queries.clear()
                    terms = cols["terms"][r].as_py()
                    queries[query] = ([t["term"] for t in terms], np.array([t["qtf"] for t in terms]), np.array([t["idf"] for t in terms]))
                low, most = best_of.get(query, (-math.inf, np.empty(0)))
                docs, score, scored = made.score(*queries[query], max(low, lows[r]))
                if len(docs):
                    out.append((query, made.ids[docs], score, scored))
                    if len(best_of) < REMEMBERED or query in best_of:
                        most = np.sort(np.concatenate([most, score]))[::-1][:k]
                        best_of[query] = (most[-1] if len(most) == k else -math.inf, most)
            if out:
                sizes = [len(x[1]) for x in out]
                first = np.zeros(sum(sizes), np.int64)
                first[np.cumsum([0, *sizes[:-1]])] = [x[3] for x in out]
                q = pa.array([x[0] for x in out], batch.schema.field("q_id").type).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
                doc = pa.array(np.concatenate([x[1] for x in out]).tolist(), batch.schema.field("docs").type.value_type)
                yield pa.RecordBatch.from_arrays([q, doc, pa.array(np.concatenate([x[2] for x in out])), pa.array(first)], ["q_id", "doc_id", "score", "scored"])

    return dealt.mapInArrow(run, f"q_id {q_kind}, doc_id {doc_kind}, score double, scored long")


class _Block:
    """The lists of one block, end to end, with what does not depend on the query."""

    def __init__(self, lists: list[tuple], model: str, b: float, k1: float):
        self.model, self.k1 = model, k1
        terms, docs, tfs, lens, best, avg = zip(*lists)
        self.at = {t: k for k, t in enumerate(terms)}
        self.n = np.array([len(x) for x in docs], np.int64)
        self.start = np.cumsum(self.n) - self.n
        ids = pa.concat_arrays(docs)
        numeric = pa.types.is_integer(ids.type)
        self.ids, self.slot = np.unique(ids.to_numpy() if numeric else np.array(ids.to_pylist(), object), return_inverse=True)
        self.tf, size = (pa.concat_arrays(x).to_numpy().astype(np.float64) for x in (tfs, lens))
        # the divisor of each posting's weight, and the most that each list gives for an idf of one
        under = lambda tf, size: size if model == "tf-idf" else tf + k1 * (1 - b + b * (size / avg[0]))
        self.under = under(self.tf, size)
        pairs = [np.array(x[n], np.float64) for n in ("tf", "doc_len") for x in best]
        tf, size = np.concatenate(pairs[: len(best)]), np.concatenate(pairs[len(best) :])
        most = self._weight(1.0, tf, under(tf, size))
        self.most = np.maximum.reduceat(most, np.cumsum([0, *map(len, pairs[: len(best) - 1])])) if len(best) > 1 else np.array([most.max()])

    def _weight(self, idf, tf, under):
        """In the order of operations of `scoring`."""
        return tf / under * idf if self.model == "tf-idf" else idf * tf * (self.k1 + 1) / under

    def score(self, terms: list[str], qtf: np.ndarray, idf: np.ndarray, low: float):
        """(slots, scores, postings scored) of the documents that reach `low`; what the terms they have cannot lift there is not scored."""
        none = np.empty(0, np.int64), np.empty(0), 0
        k = np.array([self.at.get(t, -1) for t in terms])
        have = np.flatnonzero(k >= 0)
        if not len(have):
            return none
        k, n = k[have], self.n[k[have]]
        most = qtf[have] * idf[have] * self.most[k]
        if most.sum() < low - SLACK:
            return none
        # postings, the terms that give most first
        order = np.argsort(-most, kind="stable")
        have, k, n, most = have[order], k[order], n[order], most[order]
        end = np.cumsum(n)
        at, term = np.repeat(self.start[k] - end + n, n) + np.arange(end[-1]), np.repeat(np.arange(len(k)), n)
        slot = self.slot[at]
        size = len(self.ids)
        # bounds of what each document's terms can give: all of it, then what the second half of the terms can still add
        half = end[np.searchsorted(np.cumsum(most), most.sum() / 2)]
        rest = np.bincount(slot[half:], most[term[half:]], size)
        left = np.bincount(slot[:half], most[term[:half]], size) + rest >= low - SLACK
        total, scored = np.zeros(size), 0
        for part in (slice(0, half), slice(half, None)):
            on = left[slot[part]]
            if on.any():
                a, t, s = at[part][on], term[part][on], slot[part][on]
                weight = qtf[have[t]] * self._weight(idf[have[t]], self.tf[a], self.under[a])
                # whole numbers below 2**53: the sum of floats is exact
                total += np.bincount(s, np.floor(weight * 1e10 + 0.5), size)
                scored += len(a)
            left &= total / 1e10 + rest >= low - SLACK
        there = np.zeros(size, bool)
        there[slot] = True
        score = np.floor(total / 1e4 + 0.5) / 1e6
        docs = np.flatnonzero(there & left & (score >= low - SLACK))
        return docs, score[docs], scored


def passes(index: Index, terms: DataFrame, k: int, model: str = "bm25", b: float = 0.75, k1: float = 1.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scan of each query's best blocks, its k best, and the scan of the blocks that can beat the k-th of these."""
    wanted = wanted_terms(index, terms, model)
    asked = wanted.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("term", "qtf", "idf"))).alias("terms"))
    bounds = block_bounds(index, wanted, model, b, k1)
    by_bound = Window.partitionBy("q_id").orderBy(F.desc("bound"), "block")
    placed = bounds.withColumn("place", F.row_number().over(by_bound))
    most = FIRST + math.ceil(2 * FIRST * k / index.block)
    lowest = F.lit(-math.inf)
    scanned = _scan(index, asked, placed.where(F.col("place") <= most).select("q_id", "block", lowest.alias("threshold")), model, b, k1, k)
    # limited and ranked once: the threshold and the result share this exchange
    first = top_k(scanned, k)
    kth = first.where(F.col("rank") == k).select("q_id", F.col("score").alias("threshold"))
    left = placed.where(F.col("place") > most).join(kth, "q_id", "left").withColumn("threshold", F.coalesce("threshold", lowest))
    second = _scan(index, asked, left.where(F.col("bound") >= F.col("threshold") - SLACK).select("q_id", "block", "threshold"), model, b, k1, k)
    return scanned, first, second


def pruned_top_k(index: Index, terms: DataFrame, k: int, model: str = "bm25", b: float = 0.75, k1: float = 1.2) -> DataFrame:
    """(q_id, doc_id, score, rank), as `scoring.search` with OR; index: one with lists (`index.persist_index`)."""
    _, first, second = passes(index, terms, k, model, b, k1)
    return top_k(first.select("q_id", "doc_id", "score").union(second.select("q_id", "doc_id", "score")), k)


def postings_of(index: Index, terms: DataFrame) -> int:
    """Postings that a search without bounds would score: an action over the terms' statistics alone."""
    return terms.join(index.term_stats, "term").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]

