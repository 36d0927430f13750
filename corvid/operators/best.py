"""The best of many candidates for many queries, kept within a task while its rows stream by."""

from __future__ import annotations

import numpy as np

#: Candidates that a task keeps for its queries, about; it sets how many queries are asked at once.
KEPT = 1 << 21


class Best:
    """The k best (score, then smaller id) of each of `count` queries. Holds some three times count * k candidates at most."""

    def __init__(self, count: int, k: int):
        self.k, self.least = k, np.full(count, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, max(2 * count * k, 1 << 16)

    def offer(self, first: int, close: np.ndarray, ids: np.ndarray, valid: np.ndarray | None = None) -> None:
        """close: a row of scores for each of the queries from `first` on, a column for each id; valid: where there is a score."""
        n = close.shape[1]
        good = ~(close < self.least[first : first + len(close), None])
        if valid is not None:
            good &= valid
        if n > self.k and np.count_nonzero(good) > 2 * self.k * len(close):
            some = close if valid is None else np.where(valid, close, -np.inf)
            good &= ~(close < np.partition(some, n - self.k, axis=1)[:, n - self.k, None])
        row, column = np.nonzero(good)
        if len(row):
            self.parts.append((row + first, ids[column], close[row, column]))
            self.held += len(row)
        if self.held > self.most:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score), by query and best first."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, ids, score = (np.concatenate(x) for x in zip(*self.parts))
        # small numbers are sorted by their bytes
        order = np.lexsort((ids, np.where(np.isnan(score), -np.inf, -score), q.astype(np.uint16) if len(self.least) <= 1 << 16 else q))
        q = q[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        q, order, last = q[place < self.k], order[place < self.k], place[place < self.k] == self.k - 1
        ids, score = ids[order], score[order]
        self.least[q[last]] = score[last]
        self.parts, self.held = [(q, ids, score)], len(q)
        return q, ids, score
