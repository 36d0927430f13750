"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, no two with a cosine of `CLOSE` or more, so that a dense
group does not take up many. A vector is described by its `NEAREST` nearest pivots. Inverted lists are kept for each label
and each set of `SHARED` pivots out of these; lists of single pivots would be a constant share of all vectors long. Dense
groups have an exact second round: each pivot has a list of all vectors with a cosine of `CLOSE` or more to it. By
the triangle inequality of angles, a vector that is near enough to a pivot has all its links in that list, and is in no list
of several pivots. So two vectors meet if they are close to one pivot or share `SHARED` of their nearest. Vectors
that meet are compared by cosine in double precision. A pair that meets in several lists counts in one only: that of the
first pivot both are close to, or else of the first `SHARED` of their common pivots. Vectors of a rare length that the
sample of pivots lacks are in one list per label and length. Equal vectors are one class
from the start, with their number, and lists over `BLOCK` members are dealt out as pairs of blocks; a task returns sums of
links and a spanning forest, never all pairs.

Defined cases: null, empty or zero vectors, vectors with null or non-finite components, and null labels link with
nothing; vectors of different length never link; rows that repeat a vec_id are vectors of their own that share the id; a null
vec_id counts as a link of others and gets its component's id, or null; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import by_batches, components, stash

NEAREST = 6
SHARED = 3
BLOCK = 2048
#: Rows of a block that are compared at once.
ROWS = 512
#: Cosine from which a vector is in a pivot's own list; pivots are farther than this from each other.
CLOSE = 0.85
#: Fewest and most pivots; between them, about the root of the number of vectors.
PIVOTS = (64, 2048)


def _vectors(column) -> list[np.ndarray | None]:
    out = []
    for x in column:
        v = x.values if x.is_valid else None
        a = None if v is None or not len(v) or v.null_count else v.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(a if a is not None and np.isfinite(a).all() and a.any() else None)
    return out


def _unit(a: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    a = a / np.abs(a).max(axis=-1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=-1, keepdims=True))


def fit_pivots(vectors: DataFrame, count: int, total: int) -> dict[int, np.ndarray]:
    """Pivots by vector length: `count` vectors of a length at most, by hash of their values, none close to another.

    total: about the number of vectors. Only those with a small hash are sorted out and exchanged, unless they are mostly copies.
    """
    usable = vectors.where("vector is not null and label is not null").where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("vector", lambda x: x != 0)
    ).select("vector")
    first = lambda some: some.distinct().orderBy(F.xxhash64("vector"), "vector").limit(4 * count).collect()
    share = 64 * count / max(1, total)
    rows = first(usable.where(F.xxhash64("vector") < int(-(2**63) + share * 2**64))) if share < 1 else []
    if len(rows) < 4 * count:
        rows = first(usable)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.vector), []).append(_unit(np.array(r.vector, np.float64)))
    return {n: _thin(np.stack(v), count) for n, v in by.items()}


def _thin(units: np.ndarray, count: int) -> np.ndarray:
    """The first `count` rows that have no cosine of `CLOSE` or more to one taken before."""
    taken, n = np.empty((min(count, len(units)), units.shape[1])), 0
    for u in units:
        if n == len(taken):
            break
        if not n or (taken[:n] @ u).max() < CLOSE:
            taken[n] = u
            n += 1
    return taken[:n]


def _settled(least: float) -> float:
    """The cosine to a pivot from which all vectors that a vector links with are in the pivot's own list."""
    angle = math.acos(CLOSE) - math.acos(min(1.0, max(-1.0, least)))
    return math.cos(angle) if angle > 0 else 2.0


def _key(head: str, *pivots: int, own: bool = False) -> int:
    return xxhash.xxh3_64_intdigest(head + ("close " if own else "") + ",".join(map(str, pivots))) - 2**63


def _describe(pivots: dict[int, np.ndarray], nearest: int, shared: int, least: float):
    enough = _settled(least) + 1e-9

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, labels = _vectors(batch.column("vector")), batch.column("label").to_pylist()
            near: list[list[int] | None] = [None] * len(vectors)
            own: list[list[int] | None] = [None] * len(vectors)
            settled = [False] * len(vectors)
            for k, v in enumerate(vectors):
                if v is not None and labels[k] is not None and len(v) not in pivots:
                    near[k], own[k] = [], []
            for size, points in pivots.items():
                at = [k for k, v in enumerate(vectors) if v is not None and len(v) == size and labels[k] is not None]
                if at:
                    close = _unit(np.stack([vectors[k] for k in at])) @ points.T
                    order = np.argsort(-close, axis=1, kind="stable")[:, : min(nearest, close.shape[1])]
                    for i, (k, row) in enumerate(zip(at, np.sort(order, axis=1).tolist())):
                        near[k], own[k], settled[k] = row, np.flatnonzero(close[i] >= CLOSE - 1e-9).tolist(), bool(close[i].max() >= enough)
            keys, class_ = [], []
            for v, label, row, mine, done in zip(vectors, labels, near, own, settled):
                if row is None:
                    keys.append(None)
                    class_.append(None)
                    continue
                head = f"{label}/{len(v)}/"
                class_.append(xxhash.xxh3_64_intdigest(v.tobytes(), xxhash.xxh32_intdigest(head)) - 2**63)
                keys.append([_key(head, p, own=True) for p in mine] + ([] if done else [_key(head, *c) for c in combinations(row, min(shared, len(row)))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(class_, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int32())), pa.array(own, pa.list_(pa.int32())), pa.array([None if r is None else v.tolist() for r, v in zip(near, vectors)], pa.list_(pa.float64())),
                 pa.array([None if x is None else str(x) for x in labels])],
                ["vec_id", "class", "keys", "near", "own", "vector", "label"],
            )

    return run


def _compare(least: float, shared: int):
    def other_lists(key, near, own, head):
        """Per row, the other lists that would come before this one: two rows that share one of these count there."""
        if not near[0]:
            return near
        for p in own[0]:
            if _key(head, p, own=True) == key:
                return [[q for q in mine if q < p] for mine in own]
        for c in combinations(near[0], min(shared, len(near[0]))):
            if _key(head, *c) == key:
                return [[-1 - q for q in mine] + [q for q in row if q < c[-1] and q not in c] for row, mine in zip(near, own)]
        raise AssertionError("a row is in a list that it does not name")

    def apart(sets, left, right):
        """For each left and right row, whether they share none of their `sets`."""
        names = {q: n for n, q in enumerate(sorted({q for s in sets for q in s}))}
        has = np.zeros((len(sets), len(names)), np.float32)
        for k, s in enumerate(sets):
            has[k, [names[q] for q in s]] = 1
        return has[left] @ has[right].T == 0

    def link(key, rows):
        """(class, class or null, links): links of one block pair, and a spanning forest of them."""
        ids, sides, sizes, near, own, vectors, labels = zip(*rows)
        left = np.array([k for k, s in enumerate(sides) if s != 1])
        right = np.array([k for k, s in enumerate(sides) if s != 0])
        if not len(left) or not len(right):
            return []
        unit, weight = _unit(np.stack(vectors)), np.array(sizes, np.float64)
        total, group, found, before = np.zeros(len(ids)), np.arange(len(ids)), [], None
        for at in range(0, len(left), ROWS):
            some = left[at : at + ROWS]
            linked = unit[some] @ unit[right].T >= least
            if sides[0] == 2:
                linked &= right > some[:, None]
            if not linked.any():
                continue
            if before is None:
                before = other_lists(key, near, own, f"{labels[0]}/{len(vectors[0])}/")
            linked &= apart(before, some, right)
            total[some] += linked @ weight[right]
            total[right] += weight[some] @ linked
            for k in np.flatnonzero(linked.any(1)):
                to = right[linked[k]]
                groups, first = np.unique(group[to], return_index=True)
                for g, j in zip(groups.tolist(), to[first].tolist()):
                    if g != group[some[k]]:
                        found.append((ids[some[k]], ids[j], 0))
                        group[group == g] = group[some[k]]
        return found + [(ids[k], None, int(total[k])) for k in np.flatnonzero(total)]

    def run(batches):
        group, key, rows = None, None, []
        for batch in batches:
            out = []
            cols = [batch.column(c) for c in ("grp", "key", "class", "side", "size", "near", "own", "vector", "label")]
            lists = [c.to_pylist() if n not in (5, 6, 7) else c for n, c in enumerate(cols)]
            for k in range(batch.num_rows):
                if lists[0][k] != group:
                    if len(rows) > 1:
                        out += link(key, rows)
                    group, key, rows = lists[0][k], lists[1][k], []
                rows.append((lists[2][k], lists[3][k], lists[4][k], lists[5][k].values.to_pylist(), lists[6][k].values.to_pylist(), lists[7][k].values.to_numpy(), lists[8][k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "n"])
        if len(rows) > 1 and (out := link(key, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "n"])

    return run


def pivot_dedup(vectors: DataFrame, least: float = 0.98, nearest: int = NEAREST, shared: int = SHARED, pivots: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. vectors: vec_id, embedding, label."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    total = base.count()
    if pivots is None:
        pivots = min(PIVOTS[1], max(PIVOTS[0], 2 ** math.ceil(math.log2(max(2, total)) / 2)))
    told = stash(
        base.transform(by_batches, _describe(fit_pivots(base, pivots, total), nearest, shared, least), "vec_id long, class long, keys array<long>, near array<int>, own array<int>, vector array<double>, label string"),
        "described",
    )
    live = told.where("class is not null")
    classes = stash(live.groupBy("class").agg(F.count("*").alias("size"), F.min("vec_id").alias("first"), F.max("keys").alias("keys")), "classes")
    rows = classes.select("class", "size", F.explode("keys").alias("key"))
    lists = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = (
        rows.join(lists, "key")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"), "key", "class", "size",
            F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    bodies = live.select("class", "near", "own", "vector", "label").dropDuplicates(["class"])
    met = stash(members.join(bodies, "class").repartition("grp").sortWithinPartitions("grp", "key").transform(by_batches, _compare(least, shared), "a long, b long, n long"), "links")
    joined = components(met.where("b is not null").select("a", "b"), "components")
    links = met.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    named = classes.join(links, "class", "left").join(joined, classes["class"] == joined["node"], "left").select("class", "size", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select("class", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id")
    out = told.select("vec_id", "class").join(named, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
