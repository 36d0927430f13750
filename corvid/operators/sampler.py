"""A sampler of parameters: tree-structured densities of good and bad trials, in batches.

What was tried is split into the best share and the rest. Each axis has a density of either, a sum of bell curves around the tried
levels and a flat part; candidates are drawn from the good densities, and those with the largest ratio of good to bad are tried next,
a batch at a time, so that one job judges many. Seeded: the same values give the same proposals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Trials that are drawn evenly before densities say anything, share of the trials that count as good, candidates for each proposal.
STARTUP, GOOD, CANDIDATES = 20, 0.2, 32


class Sampler:
    """axes: name -> levels; numbers in order are neighbours, other levels are not."""

    def __init__(self, axes: dict[str, Sequence], seed: int = 42):
        self.names, self.levels = list(axes), [list(x) for x in axes.values()]
        self.ordered = [all(isinstance(v, (int, float)) for v in x) for x in self.levels]
        self.rng = np.random.default_rng(seed)
        self.size = int(np.prod([len(x) for x in self.levels]))
        self.tried: dict[tuple, float] = {}

    def point(self, at: tuple) -> dict:
        return {n: x[k] for n, x, k in zip(self.names, self.levels, at)}

    def _density(self, axis: int, tried: list[tuple]) -> np.ndarray:
        n = len(self.levels[axis])
        out = np.full(n, 1 / n)
        if self.ordered[axis]:
            width = max(1.0, n / (2 + len(tried)))
            for at in tried:
                bell = np.exp(-0.5 * ((np.arange(n) - at[axis]) / width) ** 2)
                out += bell / bell.sum()
        else:
            out += np.bincount([at[axis] for at in tried], minlength=n)
        return out / out.sum()

    def propose(self, n: int) -> list[tuple]:
        """Up to n points that were not tried, fewer when none are left."""
        n = min(n, self.size - len(self.tried))
        best = sorted(self.tried, key=lambda at: (-self.tried[at], at))
        many = max(1, round(GOOD * len(best)))
        even = len(best) < STARTUP
        good, bad = ([self._density(k, part) for k in range(len(self.names))] for part in ((([], [])) if even else (best[:many], best[many:])))
        found: dict[tuple, float] = {}
        while len(found) < n:
            left = self.size - len(self.tried) - len(found)
            if left <= 4 * CANDIDATES:  # few are left: all of them are candidates
                drawn = list(np.ndindex(*(len(x) for x in self.levels)))
            else:
                drawn = list(zip(*(self.rng.choice(len(d), CANDIDATES * n, p=d).tolist() for d in good)))
            fresh = dict.fromkeys(tuple(map(int, at)) for at in drawn if tuple(at) not in self.tried and tuple(at) not in found)
            ratio = {at: sum(np.log(g[k] / b[k]) for g, b, k in zip(good, bad, at)) for at in fresh}
            for at in sorted(ratio, key=lambda at: -ratio[at])[: n - len(found)] if not even else list(fresh)[: n - len(found)]:
                found[at] = 0.0
        return list(found)

    def tell(self, points: list[tuple], values: list[float]) -> None:
        self.tried.update(zip(points, values))


def sample(axes: dict[str, Sequence], judge: Callable[[list[dict]], list[float]], trials: int = 100, seed: int = 42, batch: int = 20) -> list[tuple[dict, float]]:
    """All trials, best first; ties go to the point with the earlier levels. judge: the values of a batch of points."""
    sampler = Sampler(axes, seed)
    while len(sampler.tried) < trials and (points := sampler.propose(min(batch, trials - len(sampler.tried)))):
        sampler.tell(points, judge([sampler.point(at) for at in points]))
    return [(sampler.point(at), sampler.tried[at]) for at in sorted(sampler.tried, key=lambda at: (-sampler.tried[at], at))]
