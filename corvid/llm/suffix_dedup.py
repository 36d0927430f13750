"""Suffix-array dedup of byte strings, with a linear grouping construction of the suffix array.

1. Anchors. In every 200-byte string one 32-byte gram, the smallest by hash, is its anchor. Equal strings have
   equal anchors at equal places. Anchors that occur once in the corpus are dropped; only those few percent of
   positions are exchanged, never all bytes.
2. Contexts. Around each repeated anchor a text gives 168 bytes to the left and 200 from the anchor on. Equal
   contexts are merged, with their number. An anchor that very many texts have in different surroundings is split
   into groups by ranges of shifts, so that no group holds them all.
3. Suffix array. The right sides of the contexts of many anchors, packed into symbols, are one string; `suffix_array`
   sorts its suffixes, which puts contexts of an anchor into byte order. Neighbours' common prefixes then tell,
   for each shift o, which contexts share the 200-o bytes from the anchor on; with equal o bytes to the left
   the 200-byte string that starts o before the anchor is repeated.
4. Each text marks its repeated strings and drops the bytes that they cover.

Defined cases: null and empty texts are 0 bytes; texts under 200 bytes have no such string; rows that repeat a
doc_id are texts of their own in every count; a null doc_id takes part and is answered too, since rows are numbered by
content and not by id; other columns are not read. NUL bytes and clipped contexts differ (bytes are shifted by one, padding is 0).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import as_long, by_batches, keyed_text, mix, pieces, sliding_min, utf8

LENGTH = 200
GRAM = 32
SYMBOL = 40
#: Anchors with more occurrences have their contexts dealt by ranges of shifts instead of all to one group.
HOT = 4000
#: Occurrences in one text that count for that at most; over 1 is repeated in any case.
OFTEN = 16
#: Narrow at both ends: where a passage begins or ends, contexts then differ in a few bytes only, and most are equal.
SHIFTS = ((0, 3), (4, 11), (12, 35), (36, 132), (133, 156), (157, 164), (165, LENGTH - GRAM))
#: Bytes hashed at once; the arrays for them stay in a core's cache.
SEGMENT = 1 << 16

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of s, whose last symbol is smaller than all others and occurs once.

    Groups of suffixes start as those with an equal first symbol. From the greatest group down, each suffix of a
    group finds the nearest earlier suffix in a smaller group (its previous-smaller pointer); the prefixes of these
    are Lyndon words that grow by the group's own word, once for each suffix that points there, so they leave their
    groups for new, greater ones right behind. Then one pass over the order emits each group: whenever a suffix
    gets its place, those whose next smaller suffix it is come next in their groups.
    """
    n = len(s)
    order = np.argsort(np.asarray(s), kind="stable")
    sa = order.tolist()
    place = [0] * n
    for k, i in enumerate(sa):
        place[i] = k
    group = [0] * n  # where the suffix's group begins
    size = [0] * n  # by where a group begins
    begin = 0
    for k, i in enumerate(sa):
        if s[i] != s[sa[begin]]:
            begin = k
        group[i] = begin
        size[begin] += 1
    prev = [-1] * n
    end = n - 1
    while end > 0:
        top = group[sa[end]]
        members = sa[top : end + 1]
        if len(members) > 1:
            members.sort()
        count: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= top:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            if len(count) == 1:
                rounds = [list(count)]
            else:
                by: dict[int, list[int]] = {}
                for p, c in count.items():
                    by.setdefault(c, []).append(p)
                rounds = [by[c] for c in sorted(by, reverse=True)]
            for chosen in rounds:
                touched: dict[int, int] = {}
                for p in chosen:
                    g = group[p]
                    left = size[g] - 1
                    size[g] = left
                    spot = g + left
                    other, was = sa[spot], place[p]
                    sa[was], place[other] = other, was
                    sa[spot], place[p] = p, spot
                    touched[g] = touched.get(g, 0) + 1
                for p in chosen:
                    g = group[p]
                    group[p] = g + size[g] if g in touched else g
                for g, moved in touched.items():
                    new = g + size[g]
                    size[new] = moved
        end = top - 1
    out = [-1] * n
    out[0] = n - 1
    placed = [False] * n
    placed[n - 1] = True
    front = list(range(n))
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            placed[i] = True
            i = prev[i]
    return out


_POWERS = [None, None]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS[0] is None or len(_POWERS[0]) < n:
        base = 0x5851F42D4C957F2D
        inverse = pow(base, -1, 2**64)
        for k, b in enumerate((base, inverse)):
            row = np.full(max(n, SEGMENT + 2 * LENGTH), np.uint64(b))
            row[0] = 1
            _POWERS[k] = np.cumprod(row)
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of one text of bytes, or of texts that follow each other in `data`."""
    width = length - gram + 1
    at, value = [], []
    for a in range(0, len(data) - length + 1, SEGMENT):
        part = data[a : a + SEGMENT + length - 1]
        power, inverse = _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * power, out=total[1:])
        h = (total[gram:] - total[:-gram]) * inverse[: len(part) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        low = sliding_min(h, width)
        chosen = np.zeros(len(h), bool)
        # a gram is an anchor if it is the smallest of some window; ties are all anchors
        for k, m in _spread(low, width, len(h)):
            chosen[k] = h[k] == m
        found = np.flatnonzero(chosen)
        at.append(found + a)
        value.append(h[found])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, value = np.concatenate(at), np.concatenate(value)
    at, first = np.unique(at, return_index=True)
    return at, value[first]


def _spread(low: np.ndarray, width: int, n: int):
    """For each gram the greatest of the windows' minima that hold it: it is an anchor exactly if it equals that."""
    padded = np.zeros(n + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    yield slice(0, n), ~sliding_min(~padded, width)[:n]


def _first(batches):
    for batch in pieces(batches):
        keys, many, rows = [], [], []
        for k, t in enumerate(utf8(batch.column("text"))):
            if len(t) < LENGTH:
                continue
            _, h = anchors(np.frombuffer(t, np.uint8))
            h, n = np.unique(h, return_counts=True)
            keys.append(h)
            many.append(np.minimum(n, OFTEN))
            rows.append(np.full(len(h), k))
        if keys:
            ids = batch.column("row").take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([as_long(np.concatenate(keys)), pa.array(np.concatenate(many).astype(np.int32)), ids], ["h", "n", "row"])


def _contexts(t: bytes, hits: np.ndarray, hot: set[int]):
    """(group, context id, left length, context, position) for the text's anchors that are in hits.

    A group is an anchor. The contexts of an anchor in `hot` go, once for each range (a, b) of shifts, to smaller
    groups: strings that start o before the anchor, a <= o <= b, share a bytes to the left and LENGTH - b from the
    anchor on, so these bytes make the group, and no more than the strings of these shifts makes the context.
    """
    at, h = anchors(np.frombuffer(t, np.uint8))
    live = np.isin(h, hits)
    back = LENGTH - GRAM
    split: dict[tuple[int, bytes, int], list] = {}  # in periodic text the same surroundings come again and again
    for p, key in zip(at[live].tolist(), h[live].view(np.int64).tolist()):
        left = min(p, back)
        c = t[p - left : p + LENGTH]
        if key not in hot:
            yield key, xxhash.xxh3_64_intdigest(c, left) - 2**63, left, c, p
            continue
        parts = split.get((key, c, left))
        if parts is None:
            parts = split[key, c, left] = list(_split(key, c, left))
        for part in parts:
            yield *part, p


def _split(key: int, c: bytes, left: int):
    """(group, context id, left length, context) for the ranges of shifts that a hot anchor's context has strings of."""
    for a, b in SHIFTS:
        if left < a or len(c) - left < LENGTH - b:
            continue
        group = xxhash.xxh3_64_intdigest(c[left - a : left + LENGTH - b], (key + a) & (2**64 - 1)) - 2**63
        near = min(left, b)
        body = c[left - near : left + LENGTH - a]
        yield group, xxhash.xxh3_64_intdigest(body, near) - 2**63, near, body


def _hit_lists(batch):
    for hits, hot in zip(batch.column("hits"), batch.column("hot")):
        yield (hits.values.to_numpy().view(np.uint64), set(hot.values.to_pylist())) if hits.is_valid else (None, None)


def _emit_bodies(batches):
    """Each context with its bytes at first sight in this task, once more if it comes again, and then no more."""
    told: dict[tuple[int, int], int] = {}
    for batch in pieces(batches):
        rows = []
        for t, lists in zip(utf8(batch.column("text")), _hit_lists(batch)):
            for key, c, left, body, _ in _contexts(t, *lists):
                times = told.get((key, c), 0)
                if times < 2:
                    told[key, c] = times + 1
                    rows.append((key, c, left, None if times else body))
        if len(told) > 500_000:
            told.clear()
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["h", "c", "left", "bytes"])


def _emit_owners(batches):
    for batch in pieces(batches):
        rows = []
        for t, lists, row in zip(utf8(batch.column("text")), _hit_lists(batch), batch.column("row").to_pylist()):
            rows += [(key, c, row) for key, c in {x[:2] for x in _contexts(t, *lists)}]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], ["h", "c", "row"])


def repeated_shifts(h: np.ndarray, count: np.ndarray, left: np.ndarray, body: list[bytes]) -> np.ndarray:
    """Row by row (contexts of one or more anchors), the shifts o at which the string is repeated, as bits."""
    n, back = len(h), LENGTH - GRAM
    right_len = np.fromiter(map(len, body), np.int64, n) - left
    rights = np.zeros((n, LENGTH), np.uint8)
    lefts = np.zeros((n, back), np.uint8)
    for k, b in enumerate(body):
        row, cut = np.frombuffer(b, np.uint8), int(left[k])
        rights[k, : len(b) - cut] = row[cut:] + np.uint8(1)
        lefts[k, :cut] = row[:cut][::-1] + np.uint8(1)
    symbols = np.unique(rights.reshape(-1, SYMBOL).view(f"S{SYMBOL}").ravel(), return_inverse=True)[1].reshape(n, -1)
    # one string: symbols of each context, then a mark of its own; shorter contexts have the smaller marks
    marks = np.empty(n, np.int64)
    marks[np.argsort(right_len, kind="stable")] = np.arange(1, n + 1)
    wide = LENGTH // SYMBOL
    string = np.empty((n, wide + 1), np.int64)
    string[:, :wide] = symbols + n + 1
    string[:, wide] = marks
    flat = string.ravel().tolist()
    flat.append(0)
    sa = np.asarray(suffix_array(flat))
    starts = sa[(sa % (wide + 1) == 0) & (sa < n * (wide + 1))] // (wide + 1)
    starts = starts[np.argsort(h[starts], kind="stable")]  # groups of one hot anchor begin alike; each in its own stretch
    rights, lefts, right_len, left_len = rights[starts], lefts[starts], right_len[starts], left[starts]
    weight, anchor = count[starts], h[starts]
    same = rights[1:] == rights[:-1]
    common = np.where(same.all(1), LENGTH, same.argmin(1))
    common = np.minimum(common, np.minimum(right_len[1:], right_len[:-1]))
    common[anchor[1:] != anchor[:-1]] = 0
    bits = np.zeros((n, back + 1), bool)
    left_hash = np.zeros(n, np.uint64)
    # a row whose neighbours share too few bytes is alone in its run: it needs no look unless it stands for several
    near = np.maximum(np.append(common, 0), np.insert(common, 0, 0))
    for o in range(back + 1):
        if o:
            left_hash = mix(left_hash + lefts[:, o - 1].astype(np.uint64) + np.uint64(o << 8))
        need = LENGTH - o
        run = np.zeros(n, np.int64)
        np.cumsum(common < need, out=run[1:])
        at = np.flatnonzero((left_len >= o) & (right_len >= need) & ((near >= need) | (weight > 1)))
        if not len(at):
            continue
        key = left_hash[at] ^ mix(run[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        total = np.add.reduceat(weight[at][order], fresh)
        dup = np.repeat(total, np.diff(np.append(fresh, len(order)))) >= 2
        bits[at[order][dup], o] = True
    out = np.empty_like(bits)
    out[starts] = bits
    return out


def _judge(batches):
    """Contexts, sorted by anchor: merge equal ones, sort the suffixes of many anchors at once, send what is repeated."""
    waiting: list[list] = []
    last: dict[int, list] = {}
    anchor = None

    def close():
        if len(last) > 1 or any(v[0] > 1 for v in last.values()):
            waiting.extend([anchor, c, *v] for c, v in last.items())
        last.clear()

    def flush():
        h, c, n, left, body = map(list, zip(*waiting))
        bits = repeated_shifts(np.array(h, np.int64), np.array(n), np.array(left), body)
        any_ = bits.any(1)
        packed = np.packbits(bits[any_], axis=1)
        pick = np.flatnonzero(any_).tolist()
        waiting.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([h[k] for k in pick], pa.int64()), pa.array([c[k] for k in pick], pa.int64()), pa.array([x.tobytes() for x in packed], pa.binary())], ["h", "c", "bits"]
        )

    for batch in batches:
        for h, c, left, body in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "left", "bytes"))):
            if h != anchor:
                close()
                anchor = h
                if len(waiting) >= 3000:
                    yield flush()
            if c in last:
                last[c][0] = 2
                if last[c][2] is None:
                    last[c][1:] = [left, body]
            else:
                last[c] = [1, left, body]
    close()
    if waiting:
        yield flush()


def _answer(full: bool):
    def run(batches):
        for batch in pieces(batches):
            out = []
            for t, found, lists in zip(utf8(batch.column("text")), batch.column("found").to_pylist(), _hit_lists(batch)):
                gone = np.zeros(len(t), bool)
                if found:
                    known = {(x["h"], x["c"]): np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8))) for x in found}
                    edge = np.zeros(len(t) + 1, np.int64)
                    for key, c, _, _, p in _contexts(t, *lists):
                        shifts = known.get((key, c))
                        if shifts is not None:
                            edge[p - shifts] += 1
                            edge[p - shifts + LENGTH] -= 1
                    gone = np.cumsum(edge)[:-1] > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if spans else t
                out.append((len(t), int(gone.sum()), spans, kept))
            a, b, c, kept = zip(*out)
            last = pa.array(kept, pa.binary()) if full else pa.array([hashlib.sha256(x).hexdigest() for x in kept])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (a, b, c)), last], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def suffix_dedup(docs: DataFrame, digest: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes, or their SHA-256)."""
    texts = keyed_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    dealt = texts.repartition("row")
    first = texts.transform(by_batches, _first, "h long, n int, row long")
    repeated = first.select("h", "row", F.sum("n").over(Window.partitionBy("h")).alias("n")).where("n > 1")
    hits = repeated.groupBy("row").agg(F.collect_set("h").alias("hits"), F.collect_set(F.when(F.col("n") > hot, F.col("h"))).alias("hot"))
    holders = dealt.join(hits, "row")
    verdict = (
        holders.transform(by_batches, _emit_bodies, "h long, c long, left int, bytes binary")
        .repartition("h").sortWithinPartitions("h", "c").transform(by_batches, _judge, "h long, c long, bits binary")
    )
    owners = holders.transform(by_batches, _emit_owners, "h long, c long, row long")
    found = owners.join(verdict, ["h", "c"]).groupBy("row").agg(F.collect_list(F.struct("h", "c", "bits")).alias("found")).join(hits, "row")
    kind = "string" if digest else "binary"
    return dealt.join(found, "row", "left").transform(by_batches, _answer(not digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")
