"""Packing along a space-filling curve.

A document's hashed vector is the mean of fixed random signs over its token ids, in a few dimensions; its place on
the Hilbert curve through them is its key. Documents are range-sorted by key (doc_id and a hash of the ids
break ties, so a third of all rows with one key still spread over tasks) and laid end to end; each task cuts its
stretch of the curve into full sequences. Its rest is cut at powers of two, so that nothing is padded.

Token ids fit 16 bits here. They are made once, by the library of the vocabulary, and stashed. No pre-token of a
byte-level vocabulary begins before a single space and ends after it, so a text's ids are those of its stretches
between such spaces: each distinct stretch is encoded once per task and remembered with its bytes, up to bounds
on their number, bytes and ids. A 64-bit hash finds a remembered stretch and its bytes are compared; a text with a stretch that another
one hides by its hash, or with other white space beside a blank, is encoded in slices that end at safe places. New stretches are encoded
joined, and told apart again by the byte lengths of the ids. When a task ends, only stretches that came
again are still remembered, `KEPT` at most (some 5 MB), since Spark keeps its Python workers.

Defined cases: a null or empty text is the closing id alone; rows that repeat a doc_id, or have none, are packed
one by one; other columns are not read; long documents run over as many sequences as they need.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import by_batches, keyed_text, mix, pieces, stash, utf8

SEQUENCE = 2048
CLOSING_ID = 1
DIMENSIONS = 4
BITS = 10
VOCABULARY = "byte_bpe_50k.json"
#: Remembered stretches, ids and bytes in a task (some 100 MB at most); beyond any, the memory starts anew.
MEMORY = 1_000_000
MEMORY_IDS = 8_000_000
MEMORY_BYTES = 32_000_000
KEPT = 150_000
#: Bytes of stretches that are joined to one string, and strings that one call encodes.
JOINED, CALL = 2000, 128
#: Stretches whose ids are gathered at once, and bytes that are compared at once; longer stretches are compared alone.
GATHERED = 1 << 18
COMPARED, LONG = 1 << 20, 1 << 12
#: Where a text may be cut: before one space between two characters that are no white space.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: The first stretch of a text has no space before it, which makes it another one than its bytes say.
FIRST = np.uint64(0x5851F42D4C957F2D)

_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this file, once per process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Encoder:
    """ids(texts): what the library gives for each whole text, from remembered stretches.

    The table is sorted by key: where a stretch's ids begin, how many they are, whether it may not be joined (white space
    at an end, or empty; it has no ids then), how often it was seen, where its bytes begin in `blob`, how many they are, and
    whether it begins a text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # stretches are new here: looking for them costs more than it saves
        special = {i for i, t in self.tok.get_added_tokens_decoder().items()}
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        if len(names) > 1 << 16:
            raise ValueError("vocabularies of over 65,536 ids are not supported")
        # in a byte-level vocabulary each character of a token stands for one byte
        self.bytes_of = np.array([len(t.encode()) if i in special else len(t) for i, t in enumerate(names)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.key, self.flat = np.empty(0, np.uint64), np.empty(0, np.uint16)
        self.start, self.size, self.odd, self.seen = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool), np.empty(0, np.int32)
        self.blob, self.begin, self.length, self.lead = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def shrink(self) -> None:
        """Forget the stretches that came once, and more if over `KEPT` are left."""
        least = 2
        while (few := self.seen >= least).sum() > KEPT:
            least *= 2
        at = np.flatnonzero(few)
        self.flat, self.key, self.size, self.odd = self._gather(at), self.key[at], self.size[at], self.odd[at]
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.lead, kept = self.lead[at], self.length[at]
        self.blob = _cut(self.blob, self.begin[at], kept)
        self.begin, self.length = np.cumsum(kept) - kept, kept
        self.seen = self.seen[at] // 2  # what was seen in earlier tasks counts for less and less

    def _encode(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for k in range(0, len(strings), CALL) for e in self.tok.encode_batch_fast(strings[k : k + CALL], add_special_tokens=False)]

    def _learn(self, raw: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> None:
        """Stretches raw[start:end] of ascending, unknown keys."""
        odd = ~first & ((start == end) | _blank_starts(raw, start, end) | _blank_ends(raw, start, end))
        joint, alone = np.flatnonzero(~first & ~odd), np.flatnonzero(first)
        size = end[joint] - start[joint] + 1  # with the space before it
        bounds = np.cumsum(size)
        text = raw[np.repeat(start[joint] - 1 - bounds + size, size) + np.arange(bounds[-1])] if len(joint) else raw[:0]
        cuts = [0, *bounds[np.flatnonzero(np.diff(bounds // JOINED))].tolist(), len(text)]
        joined = [text[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:]) if a < b]
        got = self._encode(joined + [raw[a:b].tobytes().decode() for a, b in zip(start[alone].tolist(), end[alone].tolist())])
        run = np.concatenate([np.empty(0, np.uint16), *got[: len(joined)]])
        # a stretch ends with the id that ends at its last byte
        stops = np.searchsorted(np.cumsum(self.bytes_of[run]), bounds) + 1
        order = np.concatenate([joint, alone, np.flatnonzero(odd)])
        sizes = np.concatenate([np.diff(stops, prepend=0), np.array([len(x) for x in got[len(joined) :]], np.int64), np.zeros(odd.sum(), np.int64)])
        begins = np.empty(len(key), np.int64)
        begins[order] = len(self.flat) + np.cumsum(sizes) - sizes
        many = np.empty(len(key), np.int32)
        many[order] = sizes
        self.flat = np.concatenate([self.flat, run, *got[len(joined) :]])
        at = np.searchsorted(self.key, key)
        self.key, self.start, self.size = np.insert(self.key, at, key), np.insert(self.start, at, begins), np.insert(self.size, at, many)
        self.odd, self.seen, self.lead = np.insert(self.odd, at, odd), np.insert(self.seen, at, 0), np.insert(self.lead, at, first)
        size = end - start
        self.begin, self.length = np.insert(self.begin, at, len(self.blob) + np.cumsum(size) - size), np.insert(self.length, at, size)
        self.blob = np.concatenate([self.blob, _cut(raw, start, size)])

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        """The ids of all stretches in a row."""
        out = [np.empty(0, np.uint16)]
        for a in range(0, len(codes), GATHERED):
            part = codes[a : a + GATHERED]
            n = self.size[part].astype(np.int64)
            at = np.cumsum(n)
            out.append(self.flat[np.repeat(self.start[part] - at + n, n) + np.arange(at[-1])])
        return np.concatenate(out)

    def _carefully(self, text: str) -> np.ndarray:
        """The ids of a text in slices of whole stretches."""
        slices, size = [[]], 0
        for x in CUT.split(text):
            if size > JOINED:
                slices.append([])
                size = 0
            slices[-1].append(x)
            size += len(x)
        return np.concatenate(self._encode(["".join(x) for x in slices]))

    def ids(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        if not len(texts):
            return []
        if len(self.key) > MEMORY or len(self.flat) > MEMORY_IDS or len(self.blob) > MEMORY_BYTES:
            self.forget()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        blob = b" ".join([*utf8(column), b""])
        raw = np.frombuffer(blob, np.uint8)
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.flatnonzero(raw == 32)
        start = np.append(0, end[:-1] + 1)
        last = np.searchsorted(end, np.cumsum(sizes + 1) - 1) + 1  # of each text, the stretch after its last
        first = np.zeros(len(end), bool)
        first[0] = True
        first[last[:-1]] = True
        key = stretch_keys(raw, start, end) ^ np.where(first, FIRST, np.uint64(0))
        distinct, index, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.key, distinct)
        new = np.append(self.key, np.uint64(0))[at] != distinct
        new |= at == len(self.key)
        if new.any():
            index = index[new]
            self._learn(raw, distinct[new], start[index], end[index], first[index])
            at = np.searchsorted(self.key, distinct)
        self.seen[at] += count.astype(np.int32)
        codes = at[inverse]
        n = np.concatenate(([0], np.cumsum(self.size[codes], dtype=np.int64)))
        out = np.split(self._gather(codes), n[last[:-1]])
        # another stretch than the remembered one, or white space beside a blank
        bad = (self.lead[codes] != first) | _differ(raw, start, end - start, self.blob, self.begin[codes], self.length[codes]) | self.odd[codes] | (first & np.append(~first[1:], False) & ((start == end) | _blank_ends(raw, start, end)))
        for i in set(np.searchsorted(last, np.flatnonzero(bad), side="right").tolist()):
            out[i] = self._carefully(column[i].as_py())
        return out


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all runs in a row."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _chunks(size: np.ndarray):
    """Bounds of stretches in a row that have about `COMPARED` bytes together; long ones are alone."""
    cuts, long = np.flatnonzero(np.diff(np.cumsum(size) // COMPARED, prepend=0)) + 1, np.flatnonzero(size > LONG)
    bounds = np.unique(np.concatenate(([0], cuts, long, long + 1, [len(size)])))
    return zip(bounds[:-1].tolist(), bounds[1:].tolist())


def _cut(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all runs in a row."""
    out = [raw[:0]]
    for a, b in _chunks(size):
        out.append(raw[start[a] : start[a] + size[a]] if b == a + 1 else raw[_places(start[a:b], size[a:b])])
    return np.concatenate(out)


def _differ(raw: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether raw[start:start+size] is not other[begin:begin+length], for each."""
    out = size != length
    for k in np.flatnonzero(~out & (size > LONG)).tolist():
        out[k] = not np.array_equal(raw[start[k] : start[k] + size[k]], other[begin[k] : begin[k] + size[k]])
    at = np.flatnonzero(~out & (size <= LONG))
    for a, b in _chunks(size[at]):
        part = at[a:b]
        n = size[part]
        wrong = np.flatnonzero(raw[_places(start[part], n)] != other[_places(begin[part], n)])
        out[part[np.searchsorted(np.cumsum(n), wrong, side="right")]] = True
    return out


def _blank(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether 1, 2 and 3 bytes are a character of white space other than the space, in UTF-8."""
    one = ((a >= 9) & (a <= 13)) | ((a >= 28) & (a <= 31))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (general | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return one, two, three


def _blank_starts(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    a, b, c = (raw[np.minimum(start + k, len(raw) - 1)] for k in range(3))
    one, two, three = _blank(a, b, c)  # what reaches beyond a stretch's end meets the space there
    return one | two | three


def _blank_ends(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    c, b, a = (raw[np.maximum(end - k, 0)] for k in (1, 2, 3))
    none = np.zeros_like(c)
    return (end > start) & (_blank(c, none, none)[0] | _blank(b, c, none)[1] | _blank(a, b, c)[2])


def stretch_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches raw[start:end], which follow each other with a byte between."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        # so many stretches as fit a segment, one at least
        stop = max(at + 1, int(np.searchsorted(end, start[at] + SEGMENT)))
        a, b = int(start[at]), int(end[stop - 1])
        power, inverse = _powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[raw[a:b]] * power[: b - a], out=total[1:])
        s, e = start[at:stop] - a, end[at:stop] - a
        out[at:stop] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * FIRST)
        at = stop
    return out


#: Bytes that are hashed at once: the arrays stay in a core's cache.
SEGMENT = 1 << 16
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(1)
def _segment_powers() -> tuple[np.ndarray, np.ndarray]:
    return _make_powers(SEGMENT + 1024)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    power, inverse = _segment_powers() if n <= SEGMENT + 1024 else _make_powers(n)
    return power[:n], inverse[:n]


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xA24BAED4963EE407
    rows = []
    for b in (base, pow(base, -1, 2**64)):
        row = np.full(n, np.uint64(b))
        row[0] = 1
        rows.append(np.cumprod(row))
    return rows[0], rows[1]


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows), each coordinate under 2**bits.

    Coordinates are turned into the transposed index by undoing exchanges and inversions from the top bit down,
    then Gray-decoded, then their bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            x[0] = np.where(on, x[0] ^ p, x[0])
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _lanes() -> np.ndarray:
    """For each id its random signs, one in each 16 bits of a word: 1 for plus, 0 for minus."""
    h = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
    return sum(((h >> np.uint64(k)) & np.uint64(1)) << np.uint64(16 * k) for k in range(DIMENSIONS))


_LANES = _lanes()


def _sums(ids: list[np.ndarray]) -> np.ndarray:
    """Sum of the ids' signs in each dimension, for each document; 2**15 ids at a time, which 16 bits can count."""
    out = np.zeros((len(ids), DIMENSIONS), np.int64)
    for row, x in zip(out, ids):
        for a in range(0, len(x), 1 << 15):
            some = x[a : a + (1 << 15)]
            total = int(_LANES[some].sum())
            row += [2 * (total >> 16 * k & 0xFFFF) - len(some) for k in range(DIMENSIONS)]
    return out


def _encode(path: str):
    def coded(batches, enc: Encoder):
        for batch in pieces(batches):
            ids = [np.append(x, np.uint16(CLOSING_ID)) for x in enc.ids(batch.column("text"))]
            n = np.array([len(x) for x in ids])
            mean = _sums(ids) / n[:, None]
            grid = np.clip(((np.arctan(6 * mean) / np.pi) + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
            tie = [zlib.crc32(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(hilbert_key(grid)), pa.array(tie, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "curve", "tie", "ids"],
            )

    def run(batches):
        enc = encoder(path)
        try:
            yield from coded(batches, enc)
        finally:
            enc.shrink()

    return run


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(length: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 36
        sequence, used = 0, 0
        cols: list[list] = [[] for _ in range(7)]
        open_: list[tuple] = []  # pieces of the sequence that is not full yet

        def put(doc, start, ids, total, at, offset):
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            for col, v in zip(cols, (doc, start, len(ids), crc, total, base + at, offset)):
                col.append(v)

        def batch_out():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), "<u2")
                a = 0
                while a < len(ids):
                    b = min(len(ids), a + length - used)
                    open_.append((doc, a, ids[a:b], len(ids), used))
                    used += b - a
                    a = b
                    if used == length:
                        for d, s, part, total, offset in open_:
                            put(d, s, part, total, sequence, offset)
                        open_.clear()
                        sequence, used = sequence + 1, 0
            if cols[0]:
                yield batch_out()
        # what is left: sequences whose lengths are the powers of two in `used`
        left = used
        ends, at = [], 0
        while left:
            size = 1 << (left.bit_length() - 1)
            ends.append((at, at + size))
            at, left = at + size, left - size
        for d, s, part, total, offset in open_:
            for k, (lo, hi) in enumerate(ends):
                a, b = max(offset, lo), min(offset + len(part), hi)
                if a < b:
                    put(d, s + a - offset, part[a - offset : b - offset], total, sequence + k, a - lo)
        if cols[0]:
            yield batch_out()

    return run


def pack(docs: DataFrame, path: str, length: int = SEQUENCE) -> DataFrame:
    """`path`: the vocabulary, on every executor. One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    coded = stash(keyed_text(docs).transform(by_batches, _encode(path), "doc_id long, curve long, tie long, ids binary"), "ids")
    along = coded.repartitionByRange("curve", "doc_id", "tie").sortWithinPartitions("curve", "doc_id", "tie")
    return along.transform(by_batches, _pack(length), _PIECE)
