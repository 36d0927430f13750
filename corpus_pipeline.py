"""A training-data pipeline: each stage calls one operator on what its predecessor kept.

What the stages do with odd rows: a null text is never toxic, similar, cut or contaminated, and is packed as the closing id
alone; an empty text likewise. A null doc_id is kept by every stage that drops documents. Rows that repeat a doc_id
share the fate of that id in the near-dedup (equal texts stay once) and are treated one by one elsewhere. Very long texts
are read whole. Empty tables give empty results with the same columns. Columns beside doc_id, text and n_chars are carried along
unread, whatever their names; ties go to the smaller doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import own_scratch, stash, sweep, table
from corvid.llm.decontaminate import drop_contaminated
from corvid.llm.minhash_dedup import keep_one
from corvid.llm.packing import VOCABULARY, pack
from corvid.llm.substring_dedup import cut_repeats
from corvid.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rejected as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; n_chars follows."""
    return cut_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to the error budget, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed."""
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: The scores, the sketches and the tokenizer are not expressible in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with own_scratch() as mine:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = stash(docs, f"stage{k}")
                sweep(spark, mine - {docs.scratch})  # what the stage and its predecessor wrote has been used
                mine &= {docs.scratch}
    return docs
