"""A text encoder that is learned from the collection: term vectors by a truncated singular value decomposition, pooled into text vectors.

The tf-idf table has a row of length one per document. `learn` finds its leading right singular vectors by block power
iterations: a pass over the documents multiplies the table and its transpose with a block of vectors, task by task, and
nothing but one row of sums per term and task is exchanged. A term's vector is its row of the singular vectors times its idf, so
that the mean over a whole text's terms, brought to length one, is that text's row projected on them.

What goes through the driver and out with the tasks is bounded by the parameters: `vocabulary` terms times `dim` numbers, about
26 MB at the defaults. Sums are kept in fixed point, so the vectors do not depend on partitions. Null and empty texts and
texts without known terms get a vector of zeros; rows with the same id are encoded one by one; an empty table has no terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.analysis.analyzer import Analyzer
from corvid.operators.index import spread
from corvid.operators.tasks import by_tokens, tidy

#: Terms that get a vector: those of the most documents.
VOCABULARY = 50_000
#: Vectors that are iterated beside those that are kept.
OVERSAMPLE = 8
#: Numbers that a task holds at once beside the vectors (32 MB).
HELD = 1 << 22


@dataclass(frozen=True)
class TermVectors:
    terms: list[str]
    vectors: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """(place, term, vector), for storing."""
        rows = [(k, t, v) for k, (t, v) in enumerate(zip(self.terms, self.vectors.tolist(), strict=True))]
        return spark.createDataFrame(rows, "place int, term string, vector array<double>")

    @classmethod
    def of(cls, table: DataFrame, dim: int) -> TermVectors:
        """From rows as `table` gives them."""
        rows = sorted(table.select("place", "term", "vector").collect())
        return cls([r.term for r in rows], np.array([r.vector for r in rows], np.float64).reshape(len(rows), dim))


def vocabulary(docs: DataFrame, analyzer: Analyzer, text_col: str = "text", size: int = VOCABULARY, min_df: int = 2) -> DataFrame:
    """(term, df) of the terms that most documents have, ties by term; at most `size`."""
    terms = spread(docs.select(text_col)).select(F.explode(F.array_distinct(analyzer.tokens(F.col(text_col)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(size)


def bags(tokens, known):
    """(row, term, count) arrays of a batch's known terms, by row and term. tokens: an Arrow list array; known: the terms."""
    import pyarrow.compute as pc

    lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
    place = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1), np.int64)
    row = np.repeat(np.arange(len(tokens)), lengths)[place >= 0]
    key, count = np.unique(row * len(known) + place[place >= 0], return_counts=True)
    return key // max(1, len(known)), key % max(1, len(known)), count


def by_row(row: np.ndarray, width: int):
    """Slices of whole rows that make at most `HELD` numbers, or of one row."""
    starts = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + HELD // width, "right")) - 1)
        yield slice(starts[a], starts[b]), starts[a:b] - starts[a]
        a = b


def weighted_rows(docs: DataFrame, analyzer: Analyzer, text_col: str, terms: list[str], idf: np.ndarray) -> DataFrame:
    """(term, weight): the tf-idf table, a row of length one per document with known terms, as arrays by term."""

    def run(batches):
        import pyarrow as pa

        known = pa.array(terms, pa.string())
        for batch in by_tokens(batches, 0):
            row, term, count = bags(batch.column(0), known)
            if not len(row):
                continue
            weight = count * idf[term]
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            lengths = np.diff(np.append(starts, len(row)))
            weight /= np.repeat(np.sqrt(np.add.reduceat(weight * weight, starts)), lengths)
            ends = pa.array(np.append(starts, len(row)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight.astype(np.float32)))], ["term", "weight"])

    return spread(docs.select(text_col)).select(analyzer.tokens(F.col(text_col)).alias("tokens")).mapInArrow(tidy(run), "term array<int>, weight array<float>")


def gram_times(rows: DataFrame, block: np.ndarray, bits: int) -> np.ndarray:
    """The table's transpose times the table times `block` (terms x width), in one pass; sums have `bits` binary places."""
    count, width = block.shape
    block = block.astype(np.float32)  # half of what goes out with the tasks; sums and rotations are in full precision

    def run(batches):
        import pyarrow as pa

        total, met = np.zeros((count, width), np.int64), np.zeros(count, bool)
        for batch in batches:
            lists, weights = batch.column(0), np.asarray(batch.column(1).flatten(), np.float64)
            term = np.asarray(lists.flatten())
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            met[term] = True
            for part, starts in by_row(row, width):
                t, w = term[part], weights[part][:, None]
                projected = np.add.reduceat(w * block[t], starts)
                given = np.rint(w * np.repeat(projected, np.diff(np.append(starts, len(t))), axis=0) * 2.0**bits).astype(np.int64)
                order = np.argsort(t, kind="stable")
                firsts = np.flatnonzero(np.diff(t[order], prepend=-1))
                total[t[order][firsts]] += np.add.reduceat(given[order], firsts)
        found = np.flatnonzero(met)
        for a in range(0, len(found), 4096):
            some = found[a : a + 4096]
            ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(total[some].ravel()))], ["term", "sums"])

    # a task gives one row per term however much it reads, so there are some tasks per core and not one per split
    tasks = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)
    sums = tasks.mapInArrow(run, "term int, sums array<long>").groupBy("term").agg(*(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)))
    out = np.zeros((count, width))
    found = sums.toArrow()
    if len(found):
        out[np.asarray(found.column("term"))] = np.stack([np.asarray(found.column(f"s{j}")) for j in range(width)], 1) * 2.0**-bits
    return out


def learn(docs: DataFrame, dim: int = 64, analyzer: Analyzer | None = None, text_col: str = "text", size: int = VOCABULARY, min_df: int = 2, rounds: int = 4, seed: int = 42, path: str | None = None) -> TermVectors:
    """Term vectors of the whole collection. path: where the tf-idf table is written, to be read by the rounds; without one the
    executors keep it on their disks, and a lost part is made again. More rounds part singular values that lie closer together."""
    analyzer = analyzer or Analyzer()
    known = vocabulary(docs, analyzer, text_col, size, min_df).collect()
    terms, all_docs = [r.term for r in known], docs.count()
    idf = np.log((1 + all_docs) / np.array([r.df for r in known], np.float64)) if known else np.zeros(0)
    if not known:
        return TermVectors([], np.zeros((0, dim)))
    rows = weighted_rows(docs, analyzer, text_col, terms, idf)
    if path is not None:
        rows.write.mode("overwrite").parquet(path)
        rows = docs.sparkSession.read.parquet(path)
    else:
        rows = rows.persist(StorageLevel.DISK_ONLY)
    # weights and the block's columns are at most one, so a document adds at most one to a sum
    # (beyond 30 places the sums would only carry the noise of the weights, which are single precision)
    bits = min(30, 62 - all_docs.bit_length())
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(terms), min(dim + OVERSAMPLE, len(terms)))))[0]
    for _ in range(rounds):
        block = np.linalg.qr(gram_times(rows, block, bits))[0]
    inner = block.T @ gram_times(rows, block, bits)
    if path is None:
        rows.unpersist()
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    kept = [k for k in np.argsort(-values, kind="stable")[:dim] if values[k] > 1e-9 * values.max()]
    vectors = np.zeros((len(terms), dim))
    vectors[:, : len(kept)] = (block @ turn[:, kept]) * idf[:, None]
    # a singular vector has no sign of its own: its largest entry is positive
    largest = vectors[np.abs(vectors).argmax(0), np.arange(dim)]
    return TermVectors(terms, np.where(largest < 0, -vectors, vectors))


def pool(texts: DataFrame, model: TermVectors, id_col: str = "doc_id", token_col: str = "tokens", max_length: int | None = None, normalize: bool = True) -> DataFrame:
    """(id, vector): the mean of the vectors of a row's known tokens, or of those among its first max_length; zeros without any."""
    tokens = F.col(token_col) if max_length is None else F.slice(token_col, 1, max_length)
    rows = texts.select(F.col(id_col), tokens.alias("tokens"))
    terms, vectors, dim = model.terms, model.vectors, model.vectors.shape[1]

    def run(batches):
        import pyarrow as pa

        known = pa.array(terms, pa.string())
        for batch in by_tokens(batches, 1):
            out = np.zeros((batch.num_rows, dim))
            row, term, count = bags(batch.column(1), known)
            for part, starts in by_row(row, dim):
                n = count[part].astype(np.float64)
                out[row[part][starts]] = np.add.reduceat(n[:, None] * vectors[term[part]], starts) / np.add.reduceat(n, starts)[:, None]
            if normalize:
                lengths = np.sqrt((out * out).sum(1))
                out /= np.where(lengths > 0, lengths, 1.0)[:, None]
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [id_col, "vector"])

    return rows.mapInArrow(tidy(run), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, vector array<double>")


def encode(texts: DataFrame, model: TermVectors, id_col: str = "doc_id", text_col: str = "text", analyzer: Analyzer | None = None, max_length: int | None = None, normalize: bool = True) -> DataFrame:
    """(id, vector) of texts, split into terms as `learn` splits them."""
    tokens = texts.select(F.col(id_col), (analyzer or Analyzer()).tokens(F.col(text_col)).alias("tokens"))
    return pool(tokens, model, id_col, "tokens", max_length, normalize)
