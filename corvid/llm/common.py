"""What the training-data operators share: inputs, scratch tables, hashing, graph components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes that a task holds at once when it reduces edges (some 40 MB).
FOREST = 200_000
#: Text bytes that one round of vectorised work takes at most (a longer single text goes alone).
PIECE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema); each task hands its memory back when it ends, as Spark keeps its Python workers."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # another C library than glibc has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(tidy, schema)


#: Folders that were made for local sessions which name none, by application.
_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where it is unset, a local master gets a temporary one; a cluster must name it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or _MADE.get(spark.sparkContext.applicationId)
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = _MADE[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='corvid-')}"
        atexit.register(_delete, spark, known)
    return known.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the JVM may have gone already at exit
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH.discard(path)


#: Paths of the scratch tables that are there, and those of the run that this thread is in.
_SCRATCH: set[str] = set()
_RUN: ContextVar[set[str] | None] = ContextVar("run", default=None)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, lost executors cost a read.

    The folder goes when `sweep` is called or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvid-{tag}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(sweep, spark, _SCRATCH)
    _SCRATCH.add(path)
    if (mine := _RUN.get()) is not None:
        mine.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


@contextmanager
def own_scratch():
    """The scratch tables that this thread makes meanwhile, as a set that fills; other threads' are not in it."""
    mine: set[str] = set()
    before = _RUN.set(mine)
    try:
        yield mine
    finally:
        _RUN.reset(before)


def scratch() -> frozenset[str]:
    """The scratch tables that are there now."""
    return frozenset(_SCRATCH)


def sweep(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete these scratch tables: for callers that have written their results."""
    for path in list(paths):
        _delete(spark, path)


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string); every other column is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def dealt_text(docs: DataFrame, others: list[str] = ()) -> DataFrame:
    """keyed_text, dealt by a key that is never null; `others` travel as the fields of `rest`, by position.

    As no plan has to add a null filter below the exchange, all joins on `key` in one query share its shuffle files.
    """
    rest = [F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("rest")] if others else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    return rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).repartition("key")


def pieces(batches, column: str = "text", limit: int = PIECE_BYTES):
    """Cut Arrow batches so that each holds about `limit` bytes of text, and never less than a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.cumsum(sizes.astype(np.int64)) // limit
        starts = np.flatnonzero(np.diff(cuts, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (shift-multiply), on uint64 arrays."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts in a row, and each text's word count."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    out = np.empty(int(counts.sum()), np.uint64)
    at = 0
    for words in split:
        out[at : at + len(words)] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        at += len(words)
    return out, counts


def grams(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all n-word windows of the row of words, those that cross texts included."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(m, np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1)))
    step = np.uint64((0xA24BAED4963EE407 + 2 * salt) & (2**64 - 1))
    for k in range(n):
        acc = acc * step + words[k : k + m]
    return mix(acc)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for each i where that fits, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lowest(edges: DataFrame, least: Column) -> DataFrame:
    """(a, m). The key is a new expression, so that it is dealt once more: Spark can then split the join of a hot node."""
    return edges.groupBy("a").agg(least.alias("m")).select(F.expr("a ^ 0L").alias("a"), "m")


def star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b), a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both, F.least(F.min("b"), F.min("a")))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    joined = large.join(_lowest(large, F.min("b")), "a")
    ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return joined.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def _forest(batches):
    """Reduce the edges of one partition to stars on the smallest node of each local component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST:  # bounded memory: hand on what there is
            yield from _stars(parent, find)
            parent.clear()
    yield from _stars(parent, find)


def _stars(parent, find):
    rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
    if rows:
        a, b = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    edges (a long, b long), in any order and number; self-loops and nulls say nothing. Alternating
    large-star and small-star steps until nothing changes; each step's edges are written to the shared folder.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stash(by_batches(tidy, _forest, "a long, b long").distinct(), tag)
    seen = None
    while True:
        # xor of row hashes: equal exactly when the (distinct) edge sets are equal, up to 64-bit chance
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, last = mark, now
        now = stash(star_round(last), tag)
        _delete(last.sparkSession, last.scratch)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
