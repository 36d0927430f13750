"""Inverted index as tables: postings, term and document statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.analysis.analyzer import Analyzer


#: Documents in a block of a written index, about: a term has one list in each block that has it.
BLOCK = 64


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, tf), term_stats (term, df), doc_stats (doc_id, doc_len, rel_len), totals (one row: n_docs, avg_len).

    bags (doc_id, tokens) are the documents themselves, where an index is a plan and keeps every term as it stands.
    A written index has lists too (term, block, docs, tfs, lens, best), in blocks of about `block` documents, and its postings are read from them.
    """

    postings: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    totals: DataFrame
    lists: DataFrame | None = None
    block: int = BLOCK
    bags: DataFrame | None = None


def spread(docs: DataFrame) -> DataFrame:
    """Few input splits (a small file is one, however many cores wait) are dealt to all cores; many are left as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < 2 * cores else docs


def term_counts(docs: DataFrame, analyzer: Analyzer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf). Partial counts are made before the exchange; words are stemmed after they are counted."""
    words = analyzer.words(spread(docs.select(id_col, text_col)), id_col, text_col).withColumnRenamed(id_col, "doc_id")
    # the null filters that some of the uses would add stand in all of them, so that all share one exchange
    return stemmed(words.where("term is not null and doc_id is not null").groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf")), analyzer)


def stemmed(counts: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Counts of words as counts of their stems; each distinct word is stemmed once."""
    if analyzer.stemmer is None:
        return counts
    return stem_counts(counts, analyzer).groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))


def stem_counts(counts: DataFrame, analyzer: Analyzer) -> DataFrame:
    """The same with a row for each word that a stem comes from."""
    if analyzer.stemmer is None:
        return counts
    # the vocabulary is read off the counts (with tf, which their other use reads too), so the texts are analysed once
    stems = analyzer.stems(counts.where("tf > 0").select("term").distinct())
    return counts.join(stems, "term").select(F.col("stem").alias("term"), "doc_id", "tf")


def document_frequency(postings: DataFrame) -> DataFrame:
    # written on tf, which every use of the postings reads, for the same reason
    return postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def derive(postings: DataFrame, term_stats: DataFrame, ids: DataFrame) -> Index:
    """Lengths count the terms that stay; the average is over all documents, those without terms included."""
    return Index(postings, term_stats, *_doc_stats(ids, postings.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))))


def _doc_stats(ids: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_stats, totals)."""
    full = ids.join(lengths, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0)).cast("long").alias("doc_len"))
    totals = full.agg(F.count("*").alias("n_docs"), (F.sum("doc_len") / F.count("*")).alias("avg_len"))
    doc_stats = full.join(F.broadcast(totals)).select("doc_id", "doc_len", (F.col("doc_len") / F.nullif("avg_len", F.lit(0.0))).alias("rel_len"))
    return doc_stats, totals


def kept_terms(stats: DataFrame, ids: DataFrame, min_df: int | float) -> DataFrame:
    if isinstance(min_df, float):
        size = ids.agg(F.count("*").alias("n_docs"))
        return stats.join(F.broadcast(size)).where(F.col("df") >= min_df * F.col("n_docs")).select("term", "df")
    return stats.where(F.col("df") >= min_df) if min_df > 1 else stats


def build_index(docs: DataFrame, analyzer: Analyzer = Analyzer(), min_df: int | float = 1, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of a collection, as a plan. A term stays if at least min_df documents have it (a float is a share of all)."""
    if min_df <= 0:
        raise ValueError("min_df must be positive")
    ids = docs.select(F.col(id_col).alias("doc_id"))
    counts = term_counts(docs, analyzer, id_col, text_col)
    stats = kept_terms(document_frequency(counts), ids, min_df)
    # with min_df 1 every term stays, and no join back is needed
    postings = counts if min_df == 1 and isinstance(min_df, int) else counts.join(stats, "term", "left_semi")
    plain = min_df == 1 and isinstance(min_df, int) and analyzer.stemmer is None and isinstance(analyzer.tokenizer, str)
    tokens = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), analyzer.tokens(F.col(text_col)).alias("tokens"))
    return replace(derive(postings, stats, ids), bags=tokens if plain else None)


def lay_lists(counts: DataFrame, blocks: int) -> DataFrame:
    """(term, block, docs, tfs, lens, best) of (term, doc_id, tf), in one exchange, by block.

    A list is ordered by length; best are its pairs (tf, doc_len) with a higher count than all shorter documents have.
    """
    dealt = counts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition("block")
    per_doc = dealt.groupBy("block", "doc_id", "term").agg(F.sum("tf").cast("int").alias("tf"))
    lengths = per_doc.withColumn("doc_len", F.sum("tf").over(Window.partitionBy("block", "doc_id")))
    rows = lengths.groupBy("block", "term").agg(F.sort_array(F.collect_list(F.struct("doc_len", "doc_id", "tf"))).alias("rows"))
    pair = "array<struct<tf int, doc_len bigint>>"
    none = F.array().cast(pair)
    # of equal lengths the last pair with the highest count stays beside lower ones, which does no harm
    best = F.aggregate("rows", none, lambda s, x: F.when((F.size(s) == 0) | (x["tf"] > F.element_at(s, -1)["tf"]), F.concat(s, F.array(F.struct(x["tf"].alias("tf"), x["doc_len"].alias("doc_len"))))).otherwise(s))
    lists = rows.select("term", "block", F.col("rows.doc_id").alias("docs"), F.col("rows.tf").alias("tfs"), F.col("rows.doc_len").alias("lens"), best.alias("best"))
    return lists.sortWithinPartitions("term", "block")


def persist_index(docs: DataFrame, path: str, analyzer: Analyzer = Analyzer(), min_df: int | float = 1, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> Index:
    """Build and write an index. Texts are analysed once: counts are written first, if they are read more than once, and the
    statistics are derived from the written lists. Files are sorted by term, so that a filter on a query's terms reads few row groups."""
    if min_df <= 0:
        raise ValueError("min_df must be positive")
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("doc_id"))
    words = replace(analyzer, stemmer=None, stopwords=analyzer.stops)
    counts = term_counts(docs, words, id_col, text_col)
    pruned = min_df != 1 or isinstance(min_df, float)
    if pruned or analyzer.stemmer is not None:
        counts.write.mode("overwrite").parquet(f"{path}/counts")
        counts = stem_counts(spark.read.parquet(f"{path}/counts"), analyzer)
    if pruned:
        whole = counts.groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))
        counts = whole.join(kept_terms(document_frequency(whole), ids, min_df), "term", "left_semi")
    lay_lists(counts, max(1, -(-docs.count() // block))).write.mode("overwrite").parquet(f"{path}/lists")
    lists = spark.read.parquet(f"{path}/lists")
    lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).write.mode("overwrite").parquet(f"{path}/term_stats")
    lengths = lists.select(F.explode(F.arrays_zip("docs", "lens")).alias("x")).groupBy(F.col("x.docs").alias("doc_id")).agg(F.max("x.lens").alias("doc_len"))
    _doc_stats(ids, lengths)[0].write.mode("overwrite").parquet(f"{path}/doc_stats")
    stats = spark.read.parquet(f"{path}/doc_stats")
    stats.agg(F.count("*").alias("n_docs"), (F.sum("doc_len") / F.count("*")).alias("avg_len"), F.lit(block).alias("block")).write.mode("overwrite").parquet(f"{path}/totals")
    return load_index(spark, path)


def load_index(spark, path: str) -> Index:
    lists, term_stats, doc_stats, totals = (spark.read.parquet(f"{path}/{name}") for name in ("lists", "term_stats", "doc_stats", "totals"))
    postings = lists.select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("x")).select("term", F.col("x.docs").alias("doc_id"), F.col("x.tfs").alias("tf"))
    return Index(postings, term_stats, doc_stats, totals.select("n_docs", "avg_len"), lists, totals.first().block)
