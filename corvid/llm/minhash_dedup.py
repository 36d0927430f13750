"""MinHash near-dedup with min-max hashing.

Each of 72 permutations of the shingle hashes gives two signature values, the smallest and the greatest, so 144
values cost 72 evaluations. They are cut into 36 bands of four (two permutations each). At a similarity of 0.75 a
band agrees with a chance of 0.75**4, so a pair shares no band with a chance of about 1e-6.

Documents with equal shingle sets are one class from the start. A band's bucket is dropped if another bucket holds
the same classes. Classes of a bucket are compared on their full sets, by a matrix product of the set indicators. A bucket of
over `BLOCK` members is dealt out in parts of about that size, and its first member goes into each part, so that a
group of near copies of any size becomes one component at the cost of its size. Then only a bucket that still holds several
components has a second round: members of different components meet in pairs of blocks (a large component's own
blocks never meet each other), until every pair that is not known to be connected has been compared. Only links that
join two groups leave the task, never all pairs. Components are found by star contraction.

Defined cases: null texts and texts without words have an empty set and link with nothing; fewer than five words
are one shingle; rows that repeat a doc_id share its component; a null doc_id gets a null component, kept is
true; ties do not arise, since the smallest doc_id leads; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import as_long, by_batches, components, grams, keyed_text, mix, pieces, stash, utf8, word_hashes

SHINGLE = 5
PERMUTATIONS = 72
PER_BAND = 2
BLOCK = 512
_FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes([t.lower() for t in texts])
    full = grams(words, n)
    ends = np.cumsum(counts)
    out = []
    for end, k in zip(ends.tolist(), counts.tolist()):
        if k >= n:
            out.append(np.unique(full[end - k : end - n + 1]))
        else:
            out.append(grams(words[end - k : end], k, k) if k else np.empty(0, np.uint64))
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """One row of band keys per non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    keys = np.empty((len(sets), PERMUTATIONS // PER_BAND), np.uint64)
    for band in range(keys.shape[1]):
        acc = np.full(len(sets), np.uint64(band + 1))
        for f in _FACTORS[band * PER_BAND : (band + 1) * PER_BAND]:
            moved = flat * f
            acc = mix(acc ^ np.minimum.reduceat(moved, starts))
            acc = mix(acc + np.maximum.reduceat(moved, starts))
        keys[:, band] = acc
    return keys


def _sign(batches):
    for batch in pieces(batches):
        sets = shingle_sets(utf8(batch.column("text")))
        some = [k for k, s in enumerate(sets) if len(s)]
        keys = iter(bands([sets[k] for k in some]).view(np.int64)) if some else iter(())
        size = pa.array([len(s) for s in sets], pa.int64())
        digest = pa.array([(int(np.bitwise_xor.reduce(mix(s + np.uint64(9)))) ^ len(s)) - 2**63 if len(s) else None for s in sets], pa.int64())
        second = pa.array([int(np.bitwise_xor.reduce(mix(s ^ np.uint64(77)))) - 2**63 if len(s) else None for s in sets], pa.int64())
        rows = pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, digest, second, rows], ["doc_id", "n_shingles", "d1", "d2", "bands"])


def _sets(batches):
    for batch in pieces(batches):
        sets = shingle_sets(utf8(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])


def similar(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix: 100 * intersection >= percent * union."""
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    _, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    where = np.concatenate([np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(a), len(a) + len(b)), nb)])
    order = np.argsort(code, kind="stable")
    code, where = code[order], where[order]
    shared = np.zeros((len(a), len(b)), np.float32)
    wide = max(256, (8 << 20) // (len(a) + len(b)))  # indicator columns held at once
    for lo in range(0, int(code[-1]) + 1, wide):
        i, j = np.searchsorted(code, (lo, lo + wide))
        flags = np.zeros((len(a) + len(b), min(wide, int(code[-1]) + 1 - lo)), np.float32)
        flags[where[i:j], code[i:j] - lo] = 1
        shared += flags[: len(a)] @ flags[len(a) :].T
    shared = np.rint(shared).astype(np.int64)
    return 100 * shared >= percent * (na[:, None] + nb[None, :] - shared)


def _compare(percent: int):
    def link(ids, sides, sets):
        """Links that join groups of one block pair; side 0 and 1 are compared with each other, side 2 with itself too."""
        parent = list(range(len(ids)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        left = [k for k, s in enumerate(sides) if s != 1]
        right = [k for k, s in enumerate(sides) if s != 0]
        out = []
        if not left or not right:
            return out
        if len(ids) == 2:
            a, b = sets
            n = len(np.intersect1d(a, b, assume_unique=True))
            return [(ids[0], ids[1])] if 100 * n >= percent * (len(a) + len(b) - n) else []
        rows, cols = np.nonzero(similar([sets[k] for k in left], [sets[k] for k in right], percent))
        for i, j in zip(rows.tolist(), cols.tolist()):
            a, b = find(left[i]), find(right[j])
            if a != b:
                parent[a] = b
                out.append((ids[left[i]], ids[right[j]]))
        return out

    def run(batches):
        group, ids, sides, sets = None, [], [], []
        out = []
        for batch in batches:
            for g, d, s, x in zip(*(batch.column(c).to_pylist() for c in ("grp", "rep", "side", "shingles"))):
                if g != group:
                    if len(ids) > 1:
                        out += link(ids, sides, sets)
                    group, ids, sides, sets = g, [], [], []
                ids.append(d)
                sides.append(s)
                sets.append(np.frombuffer(x, np.uint64))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                out = []
        if len(ids) > 1 and (out := link(ids, sides, sets)):
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _links(members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the members (grp, rep, side) that meet in a group."""
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    full = keyed_text(docs).join(wanted.hint("merge"), "doc_id", "left_semi").transform(by_batches, _sets, "doc_id long, shingles binary").withColumnRenamed("doc_id", "rep")
    full = full.dropDuplicates(["rep", "shingles"])
    return members.join(full, "rep").repartition("grp").sortWithinPartitions("grp").transform(by_batches, _compare(percent), "a long, b long")


def _across(rows: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """Members of a second round: of each key in rows (key, rep), those of different components (found: node, component).

    A component with at least `block` members of a key has blocks of its own; the others of the key share mixed ones.
    Mixed blocks meet all blocks and themselves; a component's own blocks meet those of other components.
    """
    named = rows.join(found, rows.rep == found.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") < block, F.col("n")).otherwise(0)).alias("few")).where("kinds > 1")
    own = F.col("n") >= block
    shared = sizes.join(totals, "key").select(
        "key", "component", F.when(own, F.col("component")).alias("whose"),
        F.ceil(F.when(own, F.col("n")).otherwise(F.col("few")) / block).alias("blocks"),
    )
    dealt = named.join(shared, ["key", "component"]).select(
        "key", "rep", "whose", F.xxhash64("whose", F.pmod(F.when(F.col("whose").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("rep")), F.col("blocks"))).alias("block")
    )
    blocks = dealt.groupBy("key", "block").agg(F.max("whose").alias("whose"))
    left, right = (blocks.select("key", F.col("block").alias(x), F.col("whose").alias(f"{x}_whose")) for x in ("one", "two"))
    mixed = left.where("one_whose is null").join(right, "key").where("two_whose is not null or one <= two")
    apart = left.where("one_whose is not null").join(right.where("two_whose is not null"), "key").where("one_whose < two_whose")
    pairs = mixed.union(apart).select("key", "one", "two", F.xxhash64("key", "one", "two").alias("grp"))
    ends = pairs.select("key", "grp", F.explode(F.when(F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("block"), F.lit(2).alias("side"))))
        .otherwise(F.array(F.struct(F.col("one").alias("block"), F.lit(0).alias("side")), F.struct(F.col("two").alias("block"), F.lit(1).alias("side"))))).alias("e"))
    return dealt.join(ends.select("key", "grp", "e.block", "e.side"), ["key", "block"]).select("grp", "rep", "side")


def minhash_dedup(docs: DataFrame, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = stash(keyed_text(docs).transform(by_batches, _sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    sets = signed.select("doc_id", "d1", "d2").where("doc_id is not null and d1 is not null")
    classes = stash(sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    # the rows of each class's first document carry its bands
    rows = (
        signed.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"])
        .select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")).repartition("key")
    )
    buckets = (
        rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lead"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(3))).alias("x2")).where("n > 1")
        .groupBy("n", "lead", "x1", "x2").agg(F.min("key").alias("key"))
    )
    blocks = F.ceil(F.col("n") / block)
    members = stash(
        rows.join(buckets.select("key", "n", "lead"), "key")
        .withColumn("part", F.explode(F.when(F.col("rep") == F.col("lead"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), blocks)))))
        .select(F.xxhash64("key", "part").alias("grp"), "rep", F.lit(2).alias("side"), F.when(F.col("n") > block, F.col("key")).alias("key")),
        "buckets",
    )
    found = components(_links(members.drop("key"), docs, percent), "links")
    large = members.where("key is not null").select("key", "rep").distinct()
    again = stash(_across(large, found, block), "across")
    if not again.isEmpty():
        found = components(_links(again, docs, percent).union(found.select("node", "component")), "links")
    of_class = classes.join(found, classes.rep == found.node, "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    own = signed.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    out = own.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each component, that with its smallest doc_id, all columns; documents without a doc_id stay.

    Rows that share a doc_id share its component: if it leads, its different texts stay, each once (the rows with an equal text
    tie in all that counts here, so one of them stays).
    """
    told = stash(minhash_dedup(docs, percent), "decided")
    out = docs.join(told.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti")
    repeated = told.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.isEmpty():
        names = [f"c{k}" for k in range(len(docs.columns))]  # a name that is added may clash with one of the documents' own
        some = out.join(repeated, "doc_id", "left_semi").select(docs.columns).toDF(*names)
        id_, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
        once = Window.partitionBy(id_, F.xxhash64(text), F.xxhash64(text, F.lit("second"))).orderBy(F.lit(0))
        some = some.withColumn("once", F.row_number().over(once)).where("once = 1").select(names).toDF(*docs.columns)
        out = out.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(some)
    return out.select(docs.columns)
