"""Vector search: exact inner-product top-k, hashing, and a pluggable text encoder; `vector_index` has the inverted file."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.operators.best import KEPT, Best
from corvid.operators.index import spread
from corvid.operators.scoring import top_k
from corvid.operators.tasks import by_vectors, tidy

#: Queries that one task holds at once; more are taken in blocks of this many.
QUERY_BLOCK = 4096
#: Scores that are held at once (some 16 MB).
CELLS = 1 << 21


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v.cast("array<double>"), lambda x: x / norm)).otherwise(v.cast("array<double>"))


def exact_top_k(docs: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """(q_id, doc_id, score, rank). docs: doc_id, vector. queries: q_id, vector, a stated set of any size.

    The documents are read once for each block of at most `QUERY_BLOCK` queries, which travels with the task's code; each
    task keeps k candidates per query while its batches stream by, and exchanges these alone. So there is a task per core and not
    one per split.
    """
    return _streamed(docs, queries, k)


def lsh_top_k(docs: DataFrame, queries: DataFrame, k: int = 100, tables: int = 64, bits: int = 6, seed: int = 7) -> DataFrame:
    """Approximate top-k by random-hyperplane hashing: candidates share a bucket in some table, then exact scores.

    Candidates are a constant share of all pairs, so no pair is made as a row: documents stream past the queries as in
    `exact_top_k`, and of the pairs whose score could still be among a query's best those are candidates that have a code in common.
    """

    def hashed(x: np.ndarray) -> np.ndarray:
        planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
        code = ((x @ planes) > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits))
        return code.astype(np.uint8 if bits <= 8 else np.int64)

    return _streamed(docs, queries, k, hashed)


def _streamed(docs: DataFrame, queries: DataFrame, k: int, hashed: Callable | None = None) -> DataFrame:
    """The best k of a query. hashed: codes of vectors, a row each, of which a query and its candidates have one in common."""
    rows = spread(docs.select("doc_id", F.col("vector").cast("array<double>").alias("vector")))
    rows = rows.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    out, most = None, max(1, min(QUERY_BLOCK, KEPT // k))
    block: list = []
    asked = queries.select("q_id", F.col("vector").cast("array<double>").alias("vector"))

    schema = f"q_id {asked.schema['q_id'].dataType.simpleString()}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double"

    def scored(block):
        ids, points = [r.q_id for r in block], np.array([r.vector for r in block], np.float64)

        def run(batches):
            import pyarrow as pa

            asked_ids, kind, best = pa.array(ids), None, Best(len(points), k)
            codes = hashed(points) if hashed else None
            for part, vectors in by_vectors(batches, 1):
                kind = part.schema.field(0).type
                doc = np.asarray(part.column(0)) if pa.types.is_integer(kind) and not part.column(0).null_count else np.array(part.column(0).to_pylist(), object)
                own = hashed(vectors) if hashed else None
                step = max(1, CELLS // len(doc))
                for a in range(0, len(points), step):
                    close = np.round(points[a : a + step] @ vectors.T, 6)
                    best.offer(a, close, doc, _candidates(close, best.least[a : a + step], codes[a : a + step], own, k) if hashed else None)
            if kind is None:
                return
            q, doc, score = best.compact()
            for a in range(0, len(q), CELLS >> 4):
                s = slice(a, a + (CELLS >> 4))
                yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(q[s])), pa.array(doc[s], kind), pa.array(score[s])], ["q_id", "doc_id", "score"])

        return rows.mapInArrow(tidy(run), schema)

    for r in asked.where("vector is not null").toLocalIterator():
        block.append(r)
        if len(block) == most:
            out, block = scored(block) if out is None else out.union(scored(block)), []
    if block:
        out = scored(block) if out is None else out.union(scored(block))
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return top_k(out, k)


def _candidates(close: np.ndarray, least: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Where a query (row) and a document (column) have a code in common, of the scores that can be among the query's best k."""

    def shared(row, column):
        out, step = np.empty(len(row), bool), max(1, CELLS // asked.shape[1])
        for a in range(0, len(row), step):
            out[a : a + step] = (asked[row[a : a + step]] == own[column[a : a + step]]).any(1)
        return out

    good, some = ~(close < least[:, None]), 4 * k
    if close.shape[1] > some and np.count_nonzero(good) > some * len(close):
        # the best few have k candidates among them, mostly: what scores below the k-th of these is not asked
        top = np.argpartition(-close, some - 1, axis=1)[:, :some]
        met = shared(np.repeat(np.arange(len(close)), some), top.ravel()).reshape(top.shape)
        found = np.where(met, np.take_along_axis(close, top, 1), -np.inf)
        good &= ~(close < np.partition(found, some - k, axis=1)[:, some - k, None])
    row, column = np.nonzero(good)
    good[row, column] = shared(row, column)
    return good


def hashing_encoder(dim: int = 64, max_length: int | None = None) -> Callable:
    """A deterministic text encoder for tests and baselines: mean of signed hashes of all words, or of the first max_length."""

    def encode(texts) -> list[np.ndarray]:
        import xxhash

        out = []
        for t in texts:
            v = np.zeros(dim)
            words = (t or "").lower().split()[:max_length]
            for w in words:
                h = xxhash.xxh3_64_intdigest(w)
                v[h % dim] += 1 if h >> 63 else -1
            out.append(v / max(1, len(words)))
        return out

    return encode


def encode(texts: DataFrame, encoder: Callable, id_col: str = "doc_id", text_col: str = "text", normalize: bool = True) -> DataFrame:
    """(id, vector). `encoder` maps a list of strings to vectors; it is loaded once per task and fed Arrow batches."""
    rows = texts.select(id_col, F.col(text_col).alias("text"))

    def run(frames):
        for f in frames:
            vectors = [np.asarray(v, np.float64) for v in encoder(list(f["text"]))]
            if normalize:
                vectors = [v / n if (n := np.sqrt(v @ v)) else v for v in vectors]
            yield f.assign(vector=vectors)[[id_col, "vector"]]

    return rows.mapInPandas(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, vector array<double>")
