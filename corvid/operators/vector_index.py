"""An inverted file with product-quantised residuals, tuned to a recall target.

Cells grow with the collection: centroids of a bounded sample first, then cells that hold far more than their share are split on
the sample's members. A vector lies in its nearest cell, with a code of one byte for each few dimensions of what its centroid leaves
over. A search looks into each query's nearest cells: inner products with the codewords, a table per query, estimate all vectors
of a cell, and the best estimates are scored exactly. How many cells suffices for the recall target is fitted on
sampled vectors as queries, from where their exact neighbours lie, and stored with the model.

Lists and queries meet by (cell, shard): a large cell has shards of about `SHARD` vectors, each of which its queries visit. A task
holds a batch of vectors and one cell's queries in blocks.

The model (centroids, codewords, shards) is bounded by `CELLS_MOST` and travels with the tasks; every vector is indexed.
Vectors that are null are left out; ties go to the smaller id; scores are exact inner products, rounded to six places.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators.dense import exact_top_k
from corvid.operators.scoring import top_k
from corvid.operators.tasks import tidy

#: Vectors that centroids and codewords are learned from, and cells at most.
SAMPLE, CELLS_MOST = 20_000, 4096
#: Times its share from which a cell is split, and vectors of a shard.
CROWDED, SHARD = 4, 50_000
#: Dimensions that one byte stands for, and codewords.
STRIDE, WORDS = 4, 256
#: Queries that fit the number of cells, their neighbours, and the share of these that must be met.
TUNED_ON, TUNED_K, RECALL = 200, 10, 0.95
#: Estimates that are scored exactly, for each result wanted.
RERANK = 8
#: Numbers that are held at once (4 MB, and some ten times that with what is made of them).
HELD = 1 << 19


@dataclass
class Model:
    centroids: list[list[float]]
    words: list[list[list[float]]]  # part, codeword, dimensions
    shards: list[int]
    probes: int

    def arrays(self) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.array(self.centroids), [np.array(w) for w in self.words]

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Model:
        return cls(**json.loads(text))


def kmeans(x: np.ndarray, count: int, seed: int = 42, steps: int = 10) -> np.ndarray:
    """Lloyd steps from seeded rows; a centroid without members takes a row that is badly served."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(steps):
        near, far = nearest(x, c)
        order = np.argsort(-far, kind="stable")
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = sums / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[order[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid, and the squared distance to it."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, HELD // len(c))
    for a in range(0, len(x), step):
        d = (c * c).sum(1) - 2 * (x[a : a + step] @ c.T)
        near[a : a + step] = d.argmin(1)
        far[a : a + step] = d.min(1) + (x[a : a + step] ** 2).sum(1)
    return near, far


def _rows(vectors: DataFrame, id_col: str) -> DataFrame:
    return vectors.select(F.col(id_col), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")


def _assigned(vectors: DataFrame, id_col: str, centroids: np.ndarray) -> DataFrame:
    rows = _rows(vectors, id_col)

    def run(frames):
        for f in frames:
            if len(f):
                yield f.assign(cell=nearest(np.stack(f["vector"].to_numpy()), centroids)[0].astype(np.int32))

    return rows.mapInPandas(tidy(run), f"{id_col} {rows.schema[id_col].dataType.simpleString()}, vector array<double>, cell int")


def train(docs: DataFrame, recall: float = RECALL, seed: int = 42) -> Model:
    """docs: doc_id, vector. Runs jobs: the size, a sample by hash, the cells' sizes, the neighbours of the tuning queries."""
    rows = _rows(docs, "doc_id")
    total = rows.count()
    if not total:
        return Model([], [], [], 0)
    share = min(1.0, SAMPLE / total)
    picked = rows.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "vector").collect()
    if not picked:
        picked = rows.limit(SAMPLE).collect()
    picked = sorted(picked, key=lambda r: (r.vector, str(r.doc_id)))
    x = np.array([r.vector for r in picked])
    c = kmeans(x, min(CELLS_MOST // 2, max(1, int(2 * math.sqrt(total))), max(1, len(x) // 8)), seed)
    sizes = {r.cell: r.n for r in _assigned(rows, "doc_id", c).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    near, fair, made = nearest(x, c)[0], total / len(c), []
    for k in range(len(c)):
        own, pieces = x[near == k], min(16, int(sizes.get(k, 0) / fair))
        split = pieces >= CROWDED and len(np.unique(own, axis=0)) >= 2 * pieces
        made.append(kmeans(own, pieces, seed) if split else c[k : k + 1])
    grown = np.concatenate(made)[:CELLS_MOST]
    if len(grown) > len(c):
        c = grown
        sizes = {r.cell: r.n for r in _assigned(rows, "doc_id", c).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    left = x - c[nearest(x, c)[0]]
    words = [kmeans(left[:, a : a + STRIDE], WORDS, seed) for a in range(0, x.shape[1], STRIDE)]
    model = Model(c.tolist(), [w.tolist() for w in words], [max(1, -(-sizes.get(k, 0) // SHARD)) for k in range(len(c))], len(c))
    model.probes = _tuned(rows, model, picked[:: max(1, len(picked) // TUNED_ON)][:TUNED_ON], recall)
    return model


def _tuned(rows: DataFrame, model: Model, asked: list, recall: float) -> int:
    """The fewest cells in which the queries' exact neighbours lie, up to the target; the queries are not their own neighbours."""
    spark, c = rows.sparkSession, np.array(model.centroids)
    queries = spark.createDataFrame([(k, r.vector) for k, r in enumerate(asked)], "q_id long, vector array<double>")
    found = exact_top_k(rows, queries, TUNED_K + 1).join(rows, "doc_id").select("q_id", "doc_id", "vector").collect()  # TUNED_ON times TUNED_K rows
    own = {k: r.doc_id for k, r in enumerate(asked)}
    found = [r for r in found if r.doc_id != own[r.q_id]]
    if not found:
        return 1
    order = np.argsort(-(np.array([r.vector for r in asked]) @ c.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    cell = nearest(np.array([r.vector for r in found]), c)[0]
    needed = np.sort([place[r.q_id, k] + 1 for r, k in zip(found, cell)])
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


def lists(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, vector, cell, shard, code): the inverted file, to be written once."""
    c, words = model.arrays()
    shards = np.array(model.shards)
    rows = _assigned(docs, "doc_id", c).withColumn("hash", F.xxhash64("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            if len(f):
                cell = f["cell"].to_numpy()
                rest = np.stack(f["vector"].to_numpy()) - c[cell]
                code = np.stack([nearest(rest[:, k * STRIDE : (k + 1) * STRIDE], w)[0] for k, w in enumerate(words)], 1).astype(np.uint8)
                yield f.assign(shard=(f["hash"].to_numpy() % shards[cell]).astype(np.int32), code=[x.tobytes() for x in code]).drop(columns="hash")

    return rows.mapInPandas(tidy(run), f"doc_id {kind}, vector array<double>, cell int, shard int, code binary").repartition("cell", "shard").sortWithinPartitions("cell", "shard")


def search(filed: DataFrame, model: Model, queries: DataFrame, k: int = 100, probes: int | None = None) -> DataFrame:
    """(q_id, doc_id, score, rank) of an inverted file of `lists`."""
    return top_k(scan(filed, model, queries, k, probes).where("doc_id is not null").select("q_id", "doc_id", "score"), k)


def scan(filed: DataFrame, model: Model, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(q_id, doc_id, score, met, scored): each batch's best; met and scored, on one row of each, count the estimates and the exact scores."""
    c, words = model.arrays()
    probes = min(len(c), probes or model.probes)
    asked = _rows(queries, "q_id")
    q_kind, d_kind = asked.schema["q_id"].dataType.simpleString(), filed.schema["doc_id"].dataType.simpleString()

    def visits(frames):
        import pandas as pd

        for f in frames:
            if not len(f) or not len(c):
                continue
            x = np.stack(f["vector"].to_numpy())
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
            for n, (q, v) in enumerate(zip(f["q_id"], f["vector"])):
                each = [(int(j), s) for j in near[n] for s in range(model.shards[j])]
                yield pd.DataFrame({"q_id": [q] * len(each), "vector": [v] * len(each), "cell": [j for j, _ in each], "shard": [s for _, s in each]})

    wanted = asked.mapInPandas(tidy(visits), f"q_id {q_kind}, vector array<double>, cell int, shard int")
    null = lambda kind: F.lit(None).cast(kind)
    both = wanted.select("cell", "shard", F.lit(0).alias("kind"), "q_id", null(d_kind).alias("doc_id"), "vector", null("binary").alias("code")).union(
        filed.join(F.broadcast(wanted.select("cell").distinct()), "cell", "left_semi").select("cell", "shard", F.lit(1), null(q_kind), "doc_id", "vector", "code")  # cells are `CELLS_MOST` at most
    )
    dealt = both.repartition("cell", "shard").sortWithinPartitions("cell", "shard", "kind")

    def run(frames):
        import pandas as pd

        at, asked_ids, asked_vectors = None, [], []
        for f in frames:
            for (cell, shard), part in f.groupby(["cell", "shard"], sort=False):
                if (cell, shard) != at:
                    at, asked_ids, asked_vectors = (cell, shard), [], []
                fresh = part[part["kind"] == 0]
                asked_ids += fresh["q_id"].tolist()
                asked_vectors += fresh["vector"].tolist()
                docs = part[part["kind"] == 1]
                if not len(docs) or not asked_ids:
                    continue
                docs = docs.sort_values("doc_id", kind="stable")
                vectors, ids = np.stack(docs["vector"].to_numpy()), docs["doc_id"].to_numpy()
                code = np.frombuffer(b"".join(docs["code"]), np.uint8).reshape(len(docs), -1)
                step = max(1, HELD // len(docs))
                for a in range(0, len(asked_ids), step):
                    q = np.array(asked_vectors[a : a + step])
                    guess = np.repeat((q @ c[cell])[:, None], len(docs), 1)
                    for m, w in enumerate(words):
                        guess += (q[:, m * STRIDE : (m + 1) * STRIDE] @ w.T)[:, code[:, m]]
                    n = min(len(docs), RERANK * k)
                    best = np.sort(np.argpartition(-guess, n - 1, axis=1)[:, :n], axis=1)
                    exact = np.round(np.einsum("qd,qnd->qn", q, vectors[best]) if n * q.size <= 4 * HELD else np.stack([vectors[b] @ v for v, b in zip(q, best)]), 6)
                    order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                    many = order.shape[1]
                    first = (np.arange(len(q) * many) % many == 0).astype(np.int64)
                    yield pd.DataFrame({
                        "q_id": np.repeat(np.array(asked_ids[a : a + step], None if q_kind != "string" else object), many), "doc_id": ids[np.take_along_axis(best, order, 1)].ravel(),
                        "score": np.take_along_axis(exact, order, 1).ravel(), "met": first * len(docs), "scored": first * n,
                    })

    return dealt.mapInPandas(tidy(run), f"q_id {q_kind}, doc_id {d_kind}, score double, met long, scored long")
