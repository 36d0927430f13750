"""Retrievers: thin classes around the operators; they alone run actions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.analysis.analyzer import Analyzer
from corvid.operators import bitmaps, blockmax, dense, evaluation, filters, fusion, scoring, term_vectors, vector_index
from corvid.operators.index import Index, load_index, persist_index
from corvid.sources.collections import IndexFolder, apply_callback, from_rows, get_doc, get_docs, read_collection, write_results

#: Postings from which bounds pay: two more exchanges and some seconds of starting jobs against scoring all of them.
PRUNE_FROM = 100_000_000
_BASE = {"path": "corvid-data"}


def set_base_path(path: str) -> None:
    """Where index folders are, unless a retriever is given its own base."""
    _BASE["path"] = path


def _queries(spark: SparkSession, given: str | Iterable[Mapping] | DataFrame) -> DataFrame:
    if isinstance(given, DataFrame):
        return given
    if isinstance(given, str):
        return spark.createDataFrame([("q", given)], "q_id string, text string")
    return spark.createDataFrame([(str(q["id"]), q["text"]) for q in given], "q_id string, text string")


class _Retriever:
    """What all retrievers share: the stored documents, lookups, deletion."""

    def __init__(self, spark: SparkSession, index_name: str = "new-index", base_path: str | None = None):
        self.spark, self.index_name = spark, index_name
        self.folder = IndexFolder(spark, base_path or _BASE["path"], index_name)
        self.docs: DataFrame | None = None
        self.id_col, self.text_col = "id", "text"

    def _store(self, docs: DataFrame) -> DataFrame:
        # sorted within files, so that a lookup by id reads few row groups
        docs.sortWithinPartitions(self.id_col).write.mode("overwrite").parquet(self.folder.table("docs"))
        self.docs = self.spark.read.parquet(self.folder.table("docs"))
        return self.docs

    def index_file(self, path: str, callback: Callable | None = None, callback_schema: str | None = None, schema: str | None = None):
        return self.index(read_collection(self.spark, path, schema), callback, callback_schema)

    def get_doc(self, id_: Any) -> DataFrame:
        return get_doc(self.docs, id_, self.id_col)

    def get_docs(self, ids: list) -> DataFrame:
        return get_docs(self.docs, ids, self.id_col)

    def delete(self) -> bool:
        return self.folder.delete()

    def _results(self, run: DataFrame, return_docs: bool) -> DataFrame:
        if not return_docs:
            return run.orderBy("q_id", "rank")
        return run.join(self.docs, run.doc_id == self.docs[self.id_col]).drop("doc_id").orderBy("q_id", "rank")

    def bsearch(self, queries, cutoff: int = 100, qrels: DataFrame | None = None, path: str | None = None) -> DataFrame:
        asked = _queries(self.spark, queries)
        out = scoring.batch_results(self.msearch(asked, cutoff), asked, self.kind, qrels)
        return write_results(out, path) if path else out


@dataclass(frozen=True)
class SparseConfig:
    model: str = "bm25"
    min_df: int | float = 1
    tokenizer: Any = "whitespace"
    stemmer: Any = "english"
    stopwords: Any = "english"
    do_lowercasing: bool = True
    do_ampersand_normalization: bool = True
    do_special_chars_normalization: bool = True
    do_acronyms_normalization: bool = True
    do_punctuation_removal: bool = True
    b: float = 0.75
    k1: float = 1.2

    def analyzer(self) -> Analyzer:
        keys = ("tokenizer", "stemmer", "stopwords", *(k for k in self.__dataclass_fields__ if k.startswith("do_")))
        return Analyzer(**{k: getattr(self, k) for k in keys})


class SparseRetriever(_Retriever):
    kind = "sparse"

    def __init__(self, spark: SparkSession, index_name: str = "new-index", base_path: str | None = None, **options):
        super().__init__(spark, index_name, base_path)
        self.config = SparseConfig(**options)
        if self.config.model not in ("bm25", "tf-idf"):
            raise ValueError(f"unknown model {self.config.model!r}")
        if self.config.min_df <= 0:
            raise ValueError("min_df must be positive")
        self.analyzer = self.config.analyzer()
        self.tables: Index | None = None

    def index(self, collection: Iterable[dict] | DataFrame, callback: Callable | None = None, callback_schema: str | None = None):
        docs = self._store(apply_callback(from_rows(self.spark, collection), callback, callback_schema))
        self.tables = persist_index(docs, self.folder.path, self.analyzer, self.config.min_df, self.id_col, self.text_col)
        self.save()
        return self

    def save(self) -> None:
        # a function cannot be stored: its place is, so that an index does not come back with another in its stead
        plain = {k: {"given": getattr(v, "__name__", "function")} if callable(v) else v for k, v in asdict(self.config).items()}
        plain["stopwords"] = sorted(plain["stopwords"]) if isinstance(plain.get("stopwords"), (set, frozenset)) else plain.get("stopwords")
        self.folder.write_meta({"config": plain, "id_col": self.id_col, "text_col": self.text_col})

    @staticmethod
    def _options(meta: dict, callables: dict) -> dict:
        options = {**meta["config"], **callables}
        if missing := [k for k, v in options.items() if isinstance(v, dict)]:
            raise ValueError(f"the index was made with functions that are not stored: give {', '.join(missing)}")
        return options

    @classmethod
    def load(cls, spark: SparkSession, index_name: str, base_path: str | None = None, **callables):
        """callables: the tokenizer or stemmer functions that the index was made with."""
        meta = IndexFolder(spark, base_path or _BASE["path"], index_name).read_meta()
        self = cls(spark, index_name, base_path, **cls._options(meta, callables))
        self.id_col, self.text_col = meta["id_col"], meta["text_col"]
        self.docs, self.tables = spark.read.parquet(self.folder.table("docs")), load_index(spark, self.folder.path)
        return self

    def msearch(self, queries, cutoff: int = 100, operator: str = "OR", subset: DataFrame | None = None) -> DataFrame:
        c, asked, tables = self.config, _queries(self.spark, queries), self.tables
        if (terms := scoring.few_terms(asked, self.analyzer)) is not None:
            tables = scoring.only_terms(tables, terms)
        prune = operator == "OR" and subset is None and blockmax.postings_of(tables, scoring.query_terms(asked, self.analyzer)) > PRUNE_FROM
        return scoring.search(tables, asked, self.analyzer, c.model, c.b, c.k1, cutoff, operator, subset, prune)

    def search(self, query: str, return_docs: bool = True, cutoff: int = 100) -> DataFrame:
        return self._results(self.msearch(query, cutoff), return_docs)

    def autotune(self, queries, qrels: DataFrame, metric: str = "ndcg", cutoff: int = 100, trials: int = 100, seed: int = 42, **grid) -> DataFrame:
        """(b, k1, value) of what was tried, best first: trials of a sampler, or all points of the grid bs, k1s. The best is kept and stored."""
        if self.config.model != "bm25":
            raise ValueError("only bm25 has parameters to tune")
        given = self.tables, _queries(self.spark, queries), qrels, self.analyzer, metric
        if grid:
            tried = evaluation.tune_bm25(*given, cutoff=cutoff, **grid)
        else:
            found = evaluation.sample_bm25(*given, trials=trials, seed=seed, cutoff=cutoff)
            tried = self.spark.createDataFrame([(p["b"], p["k1"], v) for p, v in found], "b double, k1 double, value double").coalesce(1)
        best = tried.first()
        if best is not None and best.value > 0:
            self.config = SparseConfig(**{**self.config.__dict__, "b": best.b, "k1": best.k1})
            self.save()
        return tried


SearchEngine = SparseRetriever


class DenseRetriever(_Retriever):
    kind = "dense"

    def __init__(self, spark: SparkSession, index_name: str = "new-index", base_path: str | None = None, model: Callable | str | None = None, normalize: bool = True, max_length: int | None = None, use_ann: bool = True, dim: int = 64):
        """model: a function from texts to vectors, "svd" for an encoder that is learned from the collection and stored with it, or None for hashes."""
        super().__init__(spark, index_name, base_path)
        if isinstance(model, str) and model != "svd":
            raise ValueError(f"unknown model {model!r}")
        self.normalize, self.use_ann, self.dim, self.max_length, self.given = normalize, use_ann, dim, max_length, model
        self.encoder = model or dense.hashing_encoder(dim, max_length)
        self.vectors: DataFrame | None = None

    def encode(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, vector) of texts, as the index makes them."""
        if isinstance(self.encoder, term_vectors.TermVectors):
            return term_vectors.encode(texts, self.encoder, id_col, text_col, max_length=self.max_length, normalize=self.normalize)
        return dense.encode(texts, self.encoder, id_col, text_col, self.normalize)

    def _learn(self, docs: DataFrame) -> None:
        rows = self.folder.table("rows")
        term_vectors.learn(docs, self.dim, text_col=self.text_col, path=rows).table(self.spark).write.mode("overwrite").parquet(self.folder.table("terms"))
        self.folder.drop("rows")
        self.encoder = self._learned()

    def _learned(self) -> term_vectors.TermVectors:
        return term_vectors.TermVectors.of(self.spark.read.parquet(self.folder.table("terms")), self.dim)

    def index(self, collection: Iterable[dict] | DataFrame, callback: Callable | None = None, callback_schema: str | None = None, embeddings: DataFrame | None = None):
        """embeddings: (id, vector) that were made elsewhere."""
        docs = self._store(apply_callback(from_rows(self.spark, collection), callback, callback_schema))
        if self.given == "svd":
            self._learn(docs)
        made = embeddings if embeddings is not None else self.encode(docs, self.id_col, self.text_col)
        made.select(F.col(made.columns[0]).alias("doc_id"), F.col(made.columns[1]).alias("vector")).write.mode("overwrite").parquet(self.folder.table("vectors"))
        vectors, model = self.spark.read.parquet(self.folder.table("vectors")), None
        if self.use_ann:  # the inverted file is made once, and only read by searches
            model = vector_index.train(vectors)
            vector_index.lists(vectors, model).write.mode("overwrite").parquet(self.folder.table("lists"))
        encoder = "hashing" if self.given is None else "svd" if self.given == "svd" else "given"
        self.folder.write_meta({"normalize": self.normalize, "use_ann": self.use_ann, "encoder": encoder, "dim": self.dim, "max_length": self.max_length, "id_col": self.id_col, "text_col": self.text_col, "model": None if model is None else model.dumps()})
        return self._open()

    def _open(self):
        meta = self.folder.read_meta()
        self.docs, self.vectors = self.spark.read.parquet(self.folder.table("docs")), self.spark.read.parquet(self.folder.table("vectors"))
        if meta["encoder"] == "given" and self.given is None:
            raise ValueError("the index was made with an encoder that is not stored: give model")
        self.normalize, self.use_ann, self.dim, self.max_length, self.id_col, self.text_col = (meta[k] for k in ("normalize", "use_ann", "dim", "max_length", "id_col", "text_col"))
        self.given = "svd" if meta["encoder"] == "svd" else self.given
        self.encoder = self._learned() if self.given == "svd" else self.given or dense.hashing_encoder(self.dim, self.max_length)
        self.model = vector_index.Model.loads(meta["model"]) if self.use_ann else None
        self.lists = self.spark.read.parquet(self.folder.table("lists")) if self.use_ann else None
        return self

    @classmethod
    def load(cls, spark: SparkSession, index_name: str, base_path: str | None = None, model: Callable | None = None):
        """model: the encoder that the index was made with, if it was given one."""
        return cls(spark, index_name, base_path, model)._open()

    def msearch(self, queries, cutoff: int = 100) -> DataFrame:
        asked = _queries(self.spark, queries)
        vectors = asked if "vector" in asked.columns else self.encode(asked, "q_id", "text")
        if self.use_ann:
            return vector_index.search(self.lists, self.model, vectors, cutoff)
        return dense.exact_top_k(self.vectors, vectors, cutoff)

    def search(self, query: str, return_docs: bool = True, cutoff: int = 100) -> DataFrame:
        return self._results(self.msearch(query, cutoff), return_docs)


@dataclass
class Merger:
    norm: str = "min-max"
    weights: list[float] = field(default_factory=lambda: [1.0, 1.0])

    def save(self, spark: SparkSession, name: str, base_path: str | None = None) -> Merger:
        IndexFolder(spark, base_path or _BASE["path"], name).write_meta(asdict(self))
        return self

    @classmethod
    def load(cls, spark: SparkSession, name: str, base_path: str | None = None) -> Merger:
        return cls(**IndexFolder(spark, base_path or _BASE["path"], name).read_meta())

    def fuse(self, runs: list[DataFrame], cutoff: int = 100) -> DataFrame:
        return fusion.fuse(runs, self.norm, self.weights, cutoff)

    def autotune(self, runs: list[DataFrame], qrels: DataFrame, metric: str = "ndcg", trials: int = 60, seed: int = 42) -> DataFrame:
        """(norm, weight, value) of a sampler's trials, best first; the best is kept."""
        found = evaluation.sample_fusion(runs, qrels, metric, trials, seed)
        tried = qrels.sparkSession.createDataFrame([(p["norm"], p["weight"], v) for p, v in found], "norm string, weight double, value double").coalesce(1)
        best = tried.first()
        if best is not None and best.value > 0:
            self.norm, self.weights = best.norm, [best.weight, 1 - best.weight]
        return tried


class HybridRetriever(_Retriever):
    kind = "hybrid"

    def __init__(self, spark: SparkSession, index_name: str = "new-index", base_path: str | None = None, sparse: SparseRetriever | None = None, dense_: DenseRetriever | None = None, merger: Merger | None = None, **options):
        super().__init__(spark, index_name, base_path)
        self.sparse = sparse or SparseRetriever(spark, f"{index_name}-sparse", base_path, **options)
        self.dense = dense_ or DenseRetriever(spark, f"{index_name}-dense", base_path)
        self.merger = merger or Merger()

    def index(self, collection, callback: Callable | None = None, callback_schema: str | None = None):
        self.docs = self._store(apply_callback(from_rows(self.spark, collection), callback, callback_schema))
        self.sparse.index(self.docs)
        self.dense.index(self.docs)
        return self.save()

    def save(self):
        self.folder.write_meta(asdict(self.merger))
        return self

    @classmethod
    def load(cls, spark: SparkSession, index_name: str, base_path: str | None = None, model: Callable | None = None, **callables):
        self = cls(spark, index_name, base_path, SparseRetriever.load(spark, f"{index_name}-sparse", base_path, **callables), DenseRetriever.load(spark, f"{index_name}-dense", base_path, model))
        self.docs, self.merger = spark.read.parquet(self.folder.table("docs")), Merger(**self.folder.read_meta())
        return self

    def _runs(self, queries) -> list[DataFrame]:
        asked = _queries(self.spark, queries)
        return [self.sparse.msearch(asked, fusion.DEPTH), self.dense.msearch(asked, fusion.DEPTH)]

    def msearch(self, queries, cutoff: int = 100) -> DataFrame:
        return self.merger.fuse(self._runs(queries), cutoff)

    def search(self, query: str, return_docs: bool = True, cutoff: int = 100) -> DataFrame:
        return self._results(self.msearch(query, cutoff), return_docs)

    def autotune(self, queries, qrels: DataFrame, metric: str = "ndcg") -> DataFrame:
        self.sparse.autotune(queries, qrels, metric)
        tried = self.merger.autotune(self._runs(queries), qrels, metric)
        self.save()
        return tried


class AdvancedRetriever(SparseRetriever):
    """Sparse retrieval with typed metadata filters. schema: field -> id, text, number, bool, keyword or keywords."""

    def __init__(self, spark: SparkSession, schema: Mapping[str, str], index_name: str = "new-index", base_path: str | None = None, **options):
        filters.check_schema(schema)
        super().__init__(spark, index_name, base_path, **options)
        self.schema = dict(schema)
        self.id_col = next(k for k, v in schema.items() if v == "id")
        self.text_col = next((k for k, v in schema.items() if v == "text"), None)
        self.bits: bitmaps.Bitmaps | None = None

    def index(self, collection, callback: Callable | None = None, callback_schema: str | None = None):
        docs = apply_callback(from_rows(self.spark, collection), callback, callback_schema)
        filters.check_collection(docs, self.schema)
        if self.text_col is None:
            self._store(docs)
            self.save()
        else:
            super().index(docs)
        if set(self.schema.values()) & set(bitmaps.INDEXED):
            self.bits = bitmaps.build(self.docs, self.schema, self.docs.count()).write(self.folder.table("bitmaps"))
        return self

    def save(self) -> None:
        super().save()
        self.folder.write_meta({**self.folder.read_meta(), "schema": self.schema})

    @classmethod
    def load(cls, spark: SparkSession, index_name: str, base_path: str | None = None, **callables):
        meta = IndexFolder(spark, base_path or _BASE["path"], index_name).read_meta()
        self = cls(spark, meta["schema"], index_name, base_path, **cls._options(meta, callables))
        self.docs, self.tables = spark.read.parquet(self.folder.table("docs")), None if self.text_col is None else load_index(spark, self.folder.path)
        if set(self.schema.values()) & set(bitmaps.INDEXED):
            self.bits = bitmaps.Bitmaps.read(spark, self.folder.table("bitmaps"))
        return self

    def passing(self, query: Mapping[str, Any]) -> DataFrame:
        """(doc_id) of the documents that pass; where bitmaps decide all conditions, no document is read."""
        by_bits, others = bitmaps.split(filters.conditions(query, self.schema), self.schema)
        if self.bits is not None and by_bits and not others:
            return bitmaps.matching_ids(self.bits, by_bits, self.schema).withColumnRenamed("id", "doc_id")
        return self.filter_docs(query).select(F.col(self.id_col).alias("doc_id"))

    def filter_docs(self, query: Mapping[str, Any], strict: bool = False) -> DataFrame:
        """The documents that pass; strict: a keyword value that no document has is an error."""
        if strict:
            for name, _, value, _ in filters.conditions(query, self.schema):
                if self.schema.get(name) == "keyword":
                    filters.check_keyword(self.docs, name, value)
        if self.bits is not None:
            return bitmaps.filter_documents(self.docs, self.bits, self.schema, query)
        return filters.filter_documents(self.docs, self.schema, query)

    def search(self, query: str | Mapping[str, Any], return_docs: bool = True, cutoff: int = 100, operator: str = "OR", subset_doc_ids: list | None = None, strict: bool = False) -> DataFrame:
        """A query without usable terms gives every document that passes the filters, at score 1, by id and without a cutoff.

        All of these tie, so their rank is 1 and nothing is sorted in one task.
        """
        text, condition = (query, None) if isinstance(query, str) else filters.compile_query(query, self.schema)
        subset = None
        if condition is not None or subset_doc_ids is not None:
            passing = self.docs if condition is None else self.filter_docs({k: v for k, v in query.items() if k != "text"}, strict)
            if subset_doc_ids is not None:
                passing = passing.where(F.col(self.id_col).isin(list(subset_doc_ids)))
            if condition is None or subset_doc_ids is not None:
                subset = passing.select(F.col(self.id_col).alias("doc_id"))
            else:
                subset = self.passing({k: v for k, v in query.items() if k != "text"})
        known = None
        if text is not None and self.tables is not None:
            known = scoring.query_terms(_queries(self.spark, text), self.analyzer).join(self.tables.term_stats, "term", "left_semi").limit(1).count()
        if known:
            return self._results(self.msearch(text, cutoff, operator, subset), return_docs)
        every = passing if subset is not None else self.docs
        tied = [F.lit("q").alias("q_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank")]
        if return_docs:
            return every.select(*tied, "*").orderBy(self.id_col)
        return every.select(tied[0], F.col(self.id_col).alias("doc_id"), *tied[1:]).orderBy("doc_id")
