"""Rank a stream of queries against a static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corvid.analysis.analyzer import Analyzer
from corvid.operators.index import Index
from corvid.operators.scoring import search


def stream_search(queries: DataFrame, index: Index, analyzer: Analyzer, sink: Callable[[DataFrame, int], None], checkpoint: str, cutoff: int = 100, **options) -> StreamingQuery:
    """Each micro-batch of (q_id, text) is ranked as one plan; sink gets (run, batch id) and should overwrite by batch id,
    which makes a replayed batch harmless."""

    def one(batch: DataFrame, number: int) -> None:
        sink(search(index, batch, analyzer, cutoff=cutoff, **options), number)

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
