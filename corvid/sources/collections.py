"""Collections in and out: JSON lines, CSV, TSV, Parquet; lookups, embeddings and index folders."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_collection(spark: SparkSession, path: str, schema: StructType | str | None = None, callback: Callable | None = None, callback_schema: str | None = None) -> DataFrame:
    """The kind of file is told by its ending. CSV and TSV need a header and give strings unless a schema is given.

    callback maps a DataFrame to a DataFrame, or, with callback_schema, a dict to a dict (row by row, in Arrow batches).
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind in ("jsonl", "json"):
        docs = reader.json(path)
    elif kind in ("csv", "tsv"):
        docs = reader.option("header", True).csv(path, sep="," if kind == "csv" else "\t")
    elif kind == "parquet":
        docs = reader.parquet(path)
    else:
        raise ValueError(f"only .jsonl, .csv, .tsv and .parquet collections are read, not {path!r}")
    return apply_callback(docs, callback, callback_schema)


def apply_callback(docs: DataFrame, callback: Callable | None, callback_schema: str | None = None) -> DataFrame:
    if callback is None:
        return docs
    if callback_schema is None:
        return docs.transform(callback)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [callback(r) for r in b.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return docs.mapInArrow(run, callback_schema)


def from_rows(spark: SparkSession, rows: Iterable[dict] | DataFrame, schema: StructType | str | None = None) -> DataFrame:
    return rows if isinstance(rows, DataFrame) else spark.createDataFrame([r for r in rows], schema)


def get_docs(docs: DataFrame, ids: list, id_col: str = "doc_id") -> DataFrame:
    """The documents with these ids, in the order given."""
    wanted = docs.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, _place int")
    return docs.join(F.broadcast(wanted), id_col).orderBy("_place").drop("_place")


def get_doc(docs: DataFrame, id_: object, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.col(id_col) == F.lit(id_))


def with_position(docs: DataFrame, name: str = "position") -> DataFrame:
    """The rows with their place in the order in which the collection is read, counted from 0."""
    marked = docs.withColumn("_mark", F.monotonically_increasing_id())  # the partition's number, and 33 bits of the row's
    counts = dict(marked.groupBy(F.shiftright("_mark", 33).alias("part")).count().toLocalIterator())  # a row per partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    starts = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    place = starts[F.shiftright("_mark", 33)] + F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn(name, place.cast("long")).drop("_mark")


def import_embeddings(spark: SparkSession, path: str, ids: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, vector). Parquet keyed by id, or a .npy matrix, on a path that all executors see, whose rows follow the collection.

    Row k of the matrix belongs to the k-th row of `ids`, in the order in which that table is read; ids keep their type. Without
    `ids` the rows' numbers are the ids. Each task reads the rows it needs from the file.
    """
    if not path.endswith(".npy"):
        return spark.read.parquet(path)
    import numpy as np

    size = len(np.load(path, mmap_mode="r"))
    rows = spark.range(size).select(F.col("id").alias("position"), F.col("id").alias(id_col)) if ids is None else with_position(ids.select(id_col))
    if ids is not None and (n := rows.count()) != size:
        raise ValueError(f"{path} has {size} rows, and the collection {n}")

    def run(frames):
        matrix = np.load(path, mmap_mode="r")
        for f in frames:
            yield f.assign(vector=list(np.asarray(matrix[f["position"].to_numpy()], np.float64)))[[id_col, "vector"]]

    return rows.mapInPandas(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, vector array<double>")


def write_results(results: DataFrame, path: str) -> DataFrame:
    """Batch results as JSON lines, one object per query; the table is returned too."""
    results.write.mode("overwrite").json(path)
    return results


class IndexFolder:
    """<base>/collections/<name>/ with tables as Parquet and meta.json. Works on every file system that Spark knows."""

    def __init__(self, spark: SparkSession, base: str, name: str):
        self.spark, self.path = spark, f"{base.rstrip('/')}/collections/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self) -> bool:
        fs, p = self._fs(self.path)
        return fs.exists(p)

    def delete(self) -> bool:
        """True if there was something to delete."""
        fs, p = self._fs(self.path)
        return fs.exists(p) and fs.delete(p, True)

    def drop(self, name: str) -> bool:
        """Deletes one of the tables; True if there was one."""
        fs, p = self._fs(self.table(name))
        return fs.exists(p) and fs.delete(p, True)

    def write_meta(self, meta: dict) -> None:
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(self.table("meta.json"))

    def read_meta(self) -> dict:
        return json.loads(self.spark.read.text(self.table("meta.json"), wholetext=True).first()[0])
