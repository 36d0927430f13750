"""Conversation structure repair: the cheapest edits that make a conversation's roles read `(s?(ua)+)?`.

Faults come from windows and expressions: blank and truncated texts from the text alone, repeated ones from two windows, breaks
between neighbours and new turns from a lag. The edits come from a fold: sorted turn structs are collected and `aggregate` carries
four (cost, audit) structs, one for each state of the pattern (nothing yet, after s, after u, after a), whose least
expressions take the cheapest edits, ties to the ASCII-least audit. Two audits of one cost and state never are prefixes of
each other, so the least of each state is the least in the end.

A conversation of any length is folded in blocks: rows are dealt by ranges of (conversation, turn), each partition is cut into
blocks of `BLOCK` rows, and a block is folded from each of the four states. A second fold joins the blocks of a
conversation. Equal rows are counted before anything is sorted, and a text that a conversation repeats meets itself in
`SALTS` parts before it meets in one. Texts travel once, at the end, for the digest: a task streams the repaired rows of its
conversations through SHA-256 and holds one row and one audit. SHA-256 runs from the first byte to the last, so the texts of
one conversation pass through one task.

Damage (`damaged`) is what the query adds to have something to repair; `repair` takes any rows.

Defined cases: a null conversation is one of its own; null turns come first; null roles and texts are one space; rows of one turn
go by the MD5 of role and text, so equal rows lie together; an equal row of the same turn repeats the other; other roles than
system, user and assistant go by their first letter, and those that fit nowhere are given a role or deleted; gaps that 64 bits
cannot hold are null; very long texts are read whole; empty tables give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import by_batches

BLOCK = 256
#: Parts in which a text that a conversation repeats is looked for first.
SALTS = 64
#: Costs of edits; a truncated row that stays costs as much as an insertion.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Cost of what cannot be.
NEVER = 1 << 60
BLANKS = " \t\n\x0b\f\r"


def told(conversations: DataFrame) -> DataFrame:
    """(cid, conv_id, turn, role, text, copies): nulls become a space, and cid names the conversation, the null one too."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("cid"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), *plain, F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """Every fifth row or so is dropped (no copies), emptied, stripped of ends of sentences, repeated or given to the user."""
    kind = F.crc32(F.concat("cid", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    return rows.withColumn("kind", kind).select(
        "cid", "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2 * F.col("copies")).otherwise(F.col("copies")).alias("copies"),
    )


def _digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def flagged(rows: DataFrame) -> DataFrame:
    """Distinct rows (cid, turn, digest, initial, fault, copies). fault: blank, duplicate, truncated or none, of the first copy."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    own = F.when(stripped == "", "blank").when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    lines = rows.where("copies > 0").select("cid", "turn", _digest().alias("digest"), F.left("role", F.lit(1)).alias("initial"), own.alias("own"), "copies")
    distinct = lines.groupBy("cid", "turn", "digest").agg(F.first("initial").alias("initial"), F.first("own").alias("own"), F.sum("copies").alias("copies"))
    salted = distinct.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)))
    by_turn = F.col("turn").asc_nulls_first()
    # the first row of each part may be the first of all; the others repeat it
    first = F.row_number().over(Window.partitionBy("cid", "digest", "salt").orderBy(by_turn)) == 1
    parted = salted.withColumn("part", F.when(first, -1).otherwise(F.col("salt")))
    again = (F.row_number().over(Window.partitionBy("cid", "digest", "part").orderBy(by_turn)) > 1) | (F.col("part") >= 0)
    fault = F.when(F.col("own") == "blank", "blank").when(again, "duplicate").otherwise(F.col("own"))
    return parted.select("cid", "turn", "digest", "initial", fault.alias("fault"), "copies")


def _edit(state: Column, cost: int | Column, letters: str | Column) -> Column:
    """The state's (cost, audit) after an edit."""
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letters) if isinstance(letters, str) else letters).alias("audit"))


def _step(now: Column, row: Column) -> Column:
    """The four states after a row and its copies."""
    none, s, u, a = (now[k] for k in ("none", "s", "u", "a"))
    late = F.when(row["fault"] == "truncated", TRUNCATED).otherwise(0)
    open_ = F.least(none, s, a)  # where the user comes next
    fits = lambda letter: row["initial"] == letter

    def turned(direct: Column, inserted: Column, letter: str) -> list[Column]:
        """Role changed or kept, after an insertion or not."""
        keeps = lambda x, c, t: F.when(fits(letter), _edit(x, c, t))  # noqa: E731  null falls out of least
        return [_edit(direct, late + REROLE, "R"), _edit(inserted, late + INSERT + REROLE, "IR"), keeps(direct, late, "K"), keeps(inserted, late + INSERT, "IK")]

    gone = [_edit(x, DELETE, "D") for x in (none, s, u, a)]
    more = row["copies"] - 1  # what repeats in place goes
    rest = F.repeat(F.lit("D"), more.cast("int"))
    kept = [gone[0], F.least(gone[1], F.when(fits("s"), _edit(none, late, "K"))), F.least(gone[2], *turned(open_, u, "u")), F.least(gone[3], *turned(u, open_, "a"))]
    must = row["fault"].isin("blank", "duplicate")
    new = [F.when(must, g).otherwise(k) for g, k in zip(gone, kept)]
    return F.struct(*(F.when(more == 0, x).otherwise(_edit(x, DELETE * more, rest)).alias(n) for x, n in zip(new, ("none", "s", "u", "a"))))


STATES = ("none", "s", "u", "a")


def _only(state: str) -> Column:
    """The four states at the start of a fold from one of them."""
    return F.struct(*(F.struct(F.lit(0 if n == state else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(n) for n in STATES))


def folded(rows: DataFrame) -> DataFrame:
    """(cid, audit, numbers): of each conversation with rows. numbers: gaps, blank, duplicate, truncated, illegal, cost."""
    along = rows.repartitionByRange("cid", F.col("turn").asc_nulls_first(), "digest").sortWithinPartitions("cid", F.col("turn").asc_nulls_first(), "digest")
    placed = along.withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.expr(f"place div {BLOCK}"))
    in_block = Window.partitionBy("cid", "block").orderBy("place")
    legal = lambda before, after: F.concat(before, after).isin("su", "ua", "au")
    seen = placed.withColumns({"before": F.lag("initial").over(in_block), "was": F.lag("turn").over(in_block)})
    count = lambda fault: F.sum(F.when(F.col("fault") == fault, F.col("copies")).otherwise(0))
    repeats = F.when(F.col("fault") == "blank", 0).otherwise(F.col("copies") - F.when(F.col("fault") == "duplicate", 0).otherwise(1))
    blocks = seen.groupBy("cid", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "initial", "fault", "copies"))).alias("rows"),
        count("blank").alias("blank"), F.sum(repeats).alias("duplicate"), F.count_if(F.col("fault") == "truncated").alias("truncated"),
        F.sum(F.when(F.col("before").isNotNull() & ~legal(F.col("before"), F.col("initial")), 1).otherwise(0) + F.col("copies") - 1).alias("illegal"),
        F.count_if(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("was"))).alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    ends = {"first": F.col("rows")[0]["initial"], "last": F.element_at("rows", -1)["initial"]}
    step = {n: F.aggregate("rows", _only(n), _step) for n in STATES}
    matrix = blocks.select("cid", "block", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", *(c.alias(n) for n, c in ends.items()), F.struct(*(c.alias(n) for n, c in step.items())).alias("to"))
    # the blocks of a conversation, in their order
    whole = matrix.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("block", "first", "last", "low", "high", "to"))).alias("blocks"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")), F.min("low").alias("low"), F.max("high").alias("high"))

    def join(now: Column, block: Column) -> Column:
        through = lambda a, b: F.struct((now[a]["cost"] + block["to"][a][b]["cost"]).alias("cost"), F.concat(now[a]["audit"], block["to"][a][b]["audit"]).alias("audit"))
        capped = lambda x: F.when(x["cost"] >= NEVER, F.struct(F.lit(NEVER).alias("cost"), F.lit("").alias("audit"))).otherwise(x)
        return F.struct(*(capped(F.least(*(through(a, b) for a in STATES))).alias(b) for b in STATES))

    end = F.aggregate("blocks", _only("none"), join, lambda x: F.least(x["none"], _edit(x["s"], 2 * INSERT, "II"), _edit(x["u"], INSERT, "I"), x["a"]))
    one = F.col("blocks")
    # what the lags did not see: neighbours across the bounds of blocks
    next_to = lambda test: F.aggregate(F.zip_with(F.slice(one, 1, F.size(one) - 1), F.slice(one, 2, F.size(one) - 1), test), F.lit(0).cast("long"), lambda n, x: n + F.when(x, 1).otherwise(0))
    across = next_to(lambda x, y: ~legal(x["last"], y["first"]))
    same = next_to(lambda x, y: x["high"] == y["low"])
    gaps = F.coalesce(F.try_subtract(F.try_add(F.try_subtract("high", "low"), F.lit(1)), F.col("turns") - same), F.when(F.col("low").isNull(), 0))
    out = whole.withColumn("end", end)
    return out.select("cid", F.col("end.audit").alias("audit"), F.array(gaps, "blank", "duplicate", "truncated", F.col("illegal") + across, "end.cost").alias("numbers"))


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ROLES = {"none": ("u", b"user"), "s": ("u", b"user"), "u": ("a", b"assistant"), "a": ("u", b"user")}


def _walk(batches):
    """Rows come by conversation: its id, its audit and numbers if it has rows, then its rows. Gives (conv_id, role, text) of
    each repaired row, and (conv_id, numbers, audit) behind the last."""
    now, conv, audit, numbers, at, state = None, None, b"", None, 0, "none"

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == ord("I"):
            (state, role), at = _ROLES[state], at + 1
            yield conv, role, b""

    for batch in batches:
        for cid, kind, conv_id, copies, role, text, given in zip(*(batch.column(c).to_pylist() for c in ("cid", "kind", "conv_id", "copies", "role", "text", "numbers"))):
            if cid != now:
                if now is not None:
                    yield from inserts()
                    yield conv, numbers, audit
                now, conv, audit, numbers, at, state = cid, conv_id, b"", [0] * len(NUMBERS), 0, "none"
            if kind == 1:
                audit, numbers = text.encode(), given
            for _ in range(copies if kind == 2 else 0):
                yield from inserts()
                edit, at = audit[at], at + 1
                if edit == ord("K"):
                    state = role[0]
                    yield conv, role.encode(), text.encode()
                elif edit == ord("R"):
                    state, given_role = _ROLES[state]
                    yield conv, given_role, text.encode()
    if now is not None:
        yield from inserts()
        yield conv, numbers, audit


def _batches(rows, names: list[str], kinds: list):
    """Arrow batches of tuples, by number and size."""
    out, size = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
    for row in rows:
        out.append(row)
        size += len(row[-1]) + 1
        if len(out) >= 1 << 12 or size >= 1 << 22:
            yield made()
            out, size = [], 0
    if out:
        yield made()


def _digests(batches):
    def rows():
        digest, between = hashlib.sha256(), b""
        for conv, x, y in _walk(batches):
            if isinstance(x, list):
                yield conv, *x, y.decode(), digest.hexdigest()
                digest, between = hashlib.sha256(), b""
            else:
                digest.update(between + x + b":")
                digest.update(y)
                between = b"\n"

    return _batches(rows(), ["conv_id", *NUMBERS, "audit", "repaired_sha256"], [pa.int64()] * (1 + len(NUMBERS)) + [pa.string()] * 2)


def _lines(batches):
    def rows():
        place = 0
        for conv, x, y in _walk(batches):
            if isinstance(x, list):
                place = 0
            else:
                yield conv, place, x.decode(), y.decode()
                place += 1

    return _batches(rows(), ["conv_id", "place", "role", "text"], [pa.int64()] * 2 + [pa.string()] * 2)


def _dealt(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation's id, audit and rows, one after the other in one task."""
    null = lambda kind: F.lit(None).cast(kind)
    parts = (
        (ids.groupBy("cid").agg(F.first("conv_id").alias("conv_id")), {"conv_id": F.col("conv_id")}),
        (folded(flagged(rows)), {"text": F.col("audit"), "numbers": F.col("numbers")}),
        (rows.where("copies > 0"), {"turn": F.col("turn"), "digest": _digest(), "copies": F.col("copies").cast("long"), "role": F.col("role"), "text": F.col("text")}),
    )
    columns = {"conv_id": "long", "turn": "long", "digest": "string", "copies": "long", "role": "string", "text": "string", "numbers": "array<long>"}
    told_ = [df.select("cid", F.lit(k).alias("kind"), *(have.get(c, null(t)).alias(c) for c, t in columns.items())) for k, (df, have) in enumerate(parts)]
    return told_[0].union(told_[1]).union(told_[2]).repartition("cid").sortWithinPartitions("cid", "kind", F.col("turn").asc_nulls_first(), "digest")


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation of `ids`
    (cid, conv_id). rows: cid, turn, role, text, copies."""
    schema = f"conv_id long, {', '.join(f'{n} long' for n in NUMBERS)}, audit string, repaired_sha256 string"
    return _dealt(rows, ids).transform(by_batches, _digests, schema)


def repaired(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the repaired rows themselves."""
    return _dealt(rows, ids).transform(by_batches, _lines, "conv_id long, place long, role string, text string")
