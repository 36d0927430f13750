"""What tasks do with their Arrow batches: hold a bounded part of one at a time, and hand memory back when they end."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np

#: Tokens of a batch that are worked on at once, about (some 40 MB with what is made of them).
TOKENS = 1 << 18
#: Vectors of a batch that are worked on at once.
VECTORS = 2048


def tidy(run: Callable) -> Callable:
    """run, which gives its worker's free memory back when it ends: Spark keeps its Python workers, and other tasks get others."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # another C library than glibc has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def by_tokens(batches, column: int) -> Iterator:
    """Slices of the batches of whole rows that have some `TOKENS` tokens in all, or of one row. column: the place of the lists."""
    for batch in batches:
        lengths = batch.column(column).value_lengths().fill_null(0)
        ends, a = np.cumsum(np.asarray(lengths, np.int64)), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, "right")))
            yield batch.slice(a, b - a)
            a = b


def by_vectors(batches, column: int) -> Iterator[tuple]:
    """(batch, vectors as a matrix): slices of at most `VECTORS` rows whose vector is not null."""
    for batch in batches:
        batch = batch.filter(batch.column(column).is_valid())
        for a in range(0, batch.num_rows, VECTORS):
            part = batch.slice(a, VECTORS)
            lengths = np.asarray(part.column(column).value_lengths())
            if (lengths != lengths[0]).any():
                raise ValueError("vectors differ in length")
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1)
