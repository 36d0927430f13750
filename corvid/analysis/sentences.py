"""Sentence splitting by a model that is learned from the collection, without labels.

Words that almost always carry a period, are short and rarely stand without one are abbreviations (likelihood ratio
against the share of periods, weighted by length, inner periods and counts without a period). Words that follow ends of sentences
more often than chance are starters, and pairs around a period that keep together more often than chance are collocations. All
three are aggregations over the collection; all that passes the bounds is kept, and runs as literals in generated code.
A model that is too large for that stays in tables, which `count_sentences` joins with what stands around end marks.
Tokens, and pairs around an end mark, are counted as they stand; what patterns say of them is found once for each distinct one.

A period ends a sentence unless its word is an abbreviation, an initial or a number that the next word continues: a pair that keeps
together never ends one, a starter or a capitalised word that is otherwise seen in small letters does.

Defined cases: null texts have no sentences (null), blank ones an empty list; a text without end marks is one sentence; white
space inside a sentence stays as it is; without a collection the model is empty, and only initials and numbers are told.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published method: bounds of the scores of abbreviations, collocations and starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Entries of each kind that `count_sentences` puts into expressions; of more, all kinds stay in tables.
MOST = 5000
#: What a piece ends with, besides letters: end marks, then closing quotes and brackets.
_END = r"[.!?…][\"'”’)\]}»]*$"
_MARK = "\x01"


def _type(token: Column) -> Column:
    """A token in small letters, without quotes, brackets and commas around it; its period stays."""
    return F.lower(F.regexp_replace(token, r"^[\"'“‘(\[{«]+|[\"'”’)\]}»,;:]+$", ""))


def _words(text_col: str) -> Column:
    return F.array_remove(F.split(F.col(text_col), r"\s+"), "")


def _tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, n, n_next): how often each token stands in the texts, and how often behind another."""
    rows = docs.select(F.posexplode(_words(text_col)).alias("at", "token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("at") > 0).alias("n_next"))


def _pairs(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, next, n): how often each pair stands in the texts, of tokens that hold an end mark; no other can end a sentence."""
    words = docs.select(_words(text_col).alias("w")).select("w", F.slice("w", 2, F.size("w")).alias("n"))
    rows = words.where(F.size("w") > 1).select(F.explode(F.arrays_zip("w", "n")).alias("x")).select(F.col("x.w").alias("token"), F.col("x.n").alias("next"))
    token = F.col("token")
    return rows.where(token.contains(".") | token.contains("!") | token.contains("?")).where("next is not null").groupBy("token", "next").agg(F.count("*").alias("n"))


def _ratio(n_a: Column, n_b: Column, n_ab: Column, n: Column) -> Column:
    """Likelihood ratio of b after a against b anywhere, for a pair of words."""
    p, p1, p2 = n_b / n, n_ab / n_a, (n_b - n_ab) / F.greatest(n - n_a, F.lit(1))
    logs = lambda k, m, q: F.when((q <= 0) | (q >= 1), 0.0).otherwise(k * F.log(q) + (m - k) * F.log(1 - q))
    return -2 * (logs(n_ab, n_a, p) + logs(n_b - n_ab, n - n_a, p) - logs(n_ab, n_a, p1) - logs(n_b - n_ab, n - n_a, p2))


def abbreviations(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, with_period, total, score) of all words that a period follows; those of score `ABBREVIATION` are abbreviations."""
    return _scored(_tokens(docs, text_col).select(_type(F.col("token")).alias("type"), "n"))


def _scored(types: DataFrame) -> DataFrame:
    """types: type, n."""
    words = types.withColumn("dot", F.col("type").endswith("."))
    words = words.select(F.when(F.col("dot"), F.expr("left(type, length(type) - 1)")).otherwise(F.col("type")).alias("word"), "dot", "n")
    counts = words.groupBy("word").agg(F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("with_period"), F.sum("n").alias("total"))
    sums = counts.agg(F.sum("with_period").alias("periods"), F.sum("total").alias("n"))
    dots = F.length("word") - F.length(F.translate("word", ".", "")) + 1
    letters = F.length("word") - dots + 1
    p, ab, a = F.col("periods") / F.col("n"), F.col("with_period"), F.col("total")
    ratio = -2 * (ab * F.log(p) + (a - ab) * F.log(1 - p) - ab * F.log(F.lit(0.99)) - (a - ab) * F.log(F.lit(0.01)))
    score = ratio * F.exp(-letters) * dots * F.pow(letters.cast("double"), -(a - ab))
    # one condition on a sum: those on the word alone would be pushed below the counts and asked of every token
    usable = counts.where(F.when(F.col("with_period") > 0, (letters > 0) & F.expr("rlike(word, '[a-zà-öø-ÿ]') and not rlike(word, '[0-9!?]')")).otherwise(False))
    return usable.join(F.broadcast(sums)).where((p > 0) & (p < 1)).select("word", "with_period", "total", score.alias("score"))


#: What a model holds; collocations are two words with a blank between, small are words that are seen in small letters, of those that
#: follow abbreviations.
KINDS = ("abbreviations", "starters", "collocations", "small")
_PIECE = "struct<piece:string,token:string,type:string,head:string,big:boolean>"


def _pieces(c: Column) -> Column:
    """(a, b): each piece of a text and the one behind it. Only what ends with an end mark can end a sentence: a piece reaches from one such
    token to the next. Each step of the work on a piece is an array of its own, made once."""
    whole = F.regexp_extract_all(c, F.lit(r"(?sU)(.*?[.!?…][\"'”’)\]}»]*\s+|.+$)"), F.lit(1))
    worded = F.transform(whole, lambda x: F.struct(x.alias("piece"), F.array_remove(F.split(x, r"(?U)\s+"), "").alias("w")))
    outer = F.transform(worded, lambda x: F.struct(x["piece"].alias("piece"), F.try_element_at(x["w"], F.lit(1)).alias("head"), F.try_element_at(x["w"], F.lit(-1)).alias("token")))
    read = F.transform(outer, lambda x: F.struct(x["piece"].alias("piece"), x["token"].alias("token"), _type(x["token"]).alias("type"), _type(x["head"]).alias("head"), x["head"].rlike(r"(?U)^[\"'“‘(\[{«]*\p{Lu}").alias("big")))
    none = F.array(F.lit(None).cast(_PIECE))
    pairs = F.transform(F.array(F.struct(read.alias("own"))), lambda x: F.zip_with(x["own"], F.concat(F.slice(x["own"], 2, F.greatest(F.size(x["own"]), F.lit(1))), none), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))[0]
    return F.filter(pairs, lambda x: x["a"].isNotNull())


def _word(t: Column) -> Column:
    return F.regexp_replace(t, r"\.$", "")


def _follows(head: Column) -> Column:
    return F.regexp_replace(F.coalesce(head, F.lit("")), r"[.!?]+$", "")


def _dot_ends(t: Column, word: Column, follows: Column, big: Column, among: Callable[[str, Column], Column]) -> Column:
    """Whether what ends with a period ends a sentence. among: whether a word is one of a kind."""
    initial = word.rlike(r"(?U)^\p{L}$")
    number = word.rlike(r"^[0-9.,]+$") & ~big
    open_ = among("abbreviations", word) | t.endswith("..") | t.endswith("…")
    # behind an abbreviation only what looks like a beginning ends the sentence
    begins = big & (among("starters", follows) | among("small", follows))
    together = among("collocations", F.concat_ws(" ", word, follows))
    return F.when(together | number, False).when(initial, begins & among("starters", follows)).when(open_, begins).otherwise(True)


@dataclass(frozen=True)
class SentenceModel:
    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    collocations: frozenset[str] = frozenset()
    small: frozenset[str] = frozenset()

    def split(self, c: Column) -> Column:
        """The sentences of a text, as an array."""
        marked = F.transform(_pieces(c), lambda x: F.when(self._ends(x["a"], x["b"]), F.concat(x["a"]["piece"], F.lit(_MARK))).otherwise(x["a"]["piece"]))
        return F.filter(F.transform(F.split(F.array_join(marked, ""), _MARK), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")

    def _ends(self, own: Column, after: Column) -> Column:
        t = own["type"]
        among = lambda kind, x: x.isin(sorted(known)) if (known := getattr(self, kind)) else F.lit(False)
        dot = _dot_ends(t, _word(t), _follows(after["head"]), F.coalesce(after["big"], F.lit(False)), among)
        # the last piece may end without a mark
        return F.when(own["token"].rlike(_END), F.when(t.rlike(r"[!?]$"), True).otherwise(dot)).otherwise(False)

    @classmethod
    def train(cls, docs: DataFrame, text_col: str = "text") -> SentenceModel:
        """Runs a job for each of the four kinds. A model is held by the driver, whole; `count_sentences` does without where it is large."""
        tables = _learned(docs, text_col)
        try:
            return cls._of(tables)
        finally:
            for t in tables.values():
                t.unpersist()

    @classmethod
    def _of(cls, tables: dict[str, DataFrame]) -> SentenceModel:
        return cls(*(frozenset(r.x for r in tables[kind].collect()) for kind in KINDS))


def _learned(docs: DataFrame, text_col: str) -> dict[str, DataFrame]:
    """(x) of each kind. The counts are made once: the executors keep them on their disks meanwhile, then the kinds; a lost part is made again."""
    t, n = _type(F.col("token")), _type(F.col("next"))
    follows = lambda x: F.regexp_replace(x, r"[.!?]+$", "")
    tokens = _tokens(docs, text_col).select(t.alias("type"), "n", "n_next", F.col("token").rlike(r"(?U)^\p{Ll}").alias("small"))
    pairs = _pairs(docs, text_col).select(t.alias("type"), follows(n).alias("follows"), "n").groupBy("type", "follows").agg(F.sum("n").alias("n"))
    # small tables: some tasks per core, and not one per partition of the exchanges
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    tokens, pairs = tokens.coalesce(tasks).persist(StorageLevel.DISK_ONLY), pairs.coalesce(tasks).persist(StorageLevel.DISK_ONLY)
    try:
        return _kinds(tokens.withColumn("follows", follows(F.col("type"))), pairs)
    finally:
        tokens.unpersist()
        pairs.unpersist()


def _kinds(tokens: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """tokens: type, follows, small, n, n_next. pairs: type, follows, n. Every table is made before it is returned."""
    out: dict[str, DataFrame] = {}

    def held(kind: str, rows: DataFrame, x: str) -> None:
        out[kind] = rows.select(F.col(x).alias("x")).coalesce(rows.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.DISK_ONLY)
        out[kind].count()

    held("abbreviations", _scored(tokens).where(F.col("score") >= ABBREVIATION), "word")
    letter = F.col("follows").rlike(r"(?U)^\p{L}")
    kept = pairs.where(letter).select(_word(F.col("type")).alias("word"), F.col("type").rlike(r"[.!?]$").alias("mark"), F.col("type").endswith(".").alias("dot"), "follows", "n")
    kept = kept.join(out["abbreviations"].select(F.col("x").alias("word"), F.lit(True).alias("short")), "word", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    ends = F.col("mark") & ~(F.col("dot") & (F.col("short") | F.col("word").rlike(r"(?U)^\p{L}$")))
    seen = tokens.where(letter & (F.col("n_next") > 0)).groupBy("follows").agg(F.sum("n_next").alias("n_b"), F.sum(F.when(F.col("small"), F.col("n_next")).otherwise(0)).alias("n_small"))
    after = seen.join(kept.where(ends).groupBy("follows").agg(F.sum("n").alias("n_ab")), "follows", "left").select("follows", F.coalesce("n_ab", F.lit(0)).alias("n_ab"), "n_b")
    sums = after.agg(F.sum("n_ab").alias("n_a"), F.sum("n_b").alias("n"))
    column = tuple(F.col(c).cast("double") for c in ("n_a", "n_b", "n_ab", "n"))
    more = F.col("n_ab") * F.col("n") > F.col("n_a") * F.col("n_b")
    held("starters", after.join(F.broadcast(sums)).where(more & (F.col("n_ab") > 0)).select("follows", _ratio(*column).alias("score")).where(F.col("score") >= STARTER), "follows")
    around = kept.where(F.col("dot") & (F.col("short") | F.col("word").rlike(r"(?U)^\p{L}$|^[0-9]+$"))).groupBy("word", "short", "follows").agg(F.sum("n").alias("n_ab"))
    rows = around.where("n_ab > 1").join(around.groupBy("word").agg(F.sum("n_ab").alias("n_a")), "word").join(after.select("follows", "n_b"), "follows").join(F.broadcast(sums.select("n")))
    together = rows.where(more).select(F.concat_ws(" ", "word", "follows").alias("pair"), "follows", _ratio(*column).alias("score")).where(F.col("score") >= COLLOCATION)
    held("collocations", together.join(out["starters"].select(F.col("x").alias("follows")), "follows", "left_anti"), "pair")
    held("small", seen.where("n_small > 0").join(around.where("short").select("follows").distinct(), "follows", "left_semi"), "follows")
    return out


def count_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences) by a model that is learned from the same documents; null texts have none. A row for each row of docs. Runs jobs;
    the tables of a large model stay on the executors' disks, as the result reads them."""
    tables = _learned(docs, text_col)
    if all(t.count() <= MOST for t in tables.values()):
        model = SentenceModel._of(tables)
        for t in tables.values():
            t.unpersist()
        return docs.select(id_col, F.coalesce(F.size(model.split(F.col(text_col))), F.lit(0)).alias("n_sentences"))
    return _counted(docs, tables, id_col, text_col)


def _counted(docs: DataFrame, tables: dict[str, DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The same by joins with the kinds. Periods are asked of them once for each distinct surrounding, and the answers joined with the texts' periods."""
    read = docs.select(F.monotonically_increasing_id().alias("row"), id_col, _pieces(F.col(text_col)).alias("pieces"))
    marked = lambda x: F.coalesce(x["a"]["token"].rlike(_END), F.lit(False))
    sure = lambda x: marked(x) & x["a"]["type"].rlike(r"[!?]$")
    last = lambda x: x["b"].isNull()
    # the last piece ends a sentence in any case; a blank text has one piece, without a token
    alone = F.size(F.filter("pieces", lambda x: F.when(last(x), x["a"]["token"].isNotNull()).otherwise(sure(x))))
    dots = F.transform(F.filter("pieces", lambda x: ~last(x) & marked(x) & ~sure(x)), lambda x: F.struct(x["a"]["type"].alias("type"), _follows(x["b"]["head"]).alias("follows"), F.coalesce(x["b"]["big"], F.lit(False)).alias("big")))
    key = ["type", "follows", "big"]
    told = read.select(F.explode(dots).alias("x")).select("x.*").distinct().withColumn("word", _word(F.col("type"))).withColumn("pair", F.concat_ws(" ", "word", "follows"))
    for kind, on in zip(KINDS, ("word", "follows", "pair", "follows")):
        told = told.join(tables[kind].select(F.col("x").alias(on), F.lit(True).alias(kind)), on, "left").withColumn(kind, F.coalesce(kind, F.lit(False)))
    told = told.where(_dot_ends(F.col("type"), F.col("word"), F.col("follows"), F.col("big"), lambda kind, _: F.col(kind))).select(*key, F.lit(1).alias("ends"))
    # a text without periods has one row, whose key is its own, so that such texts do not meet in one task
    rows = read.select("row", id_col, alone.alias("alone"), F.posexplode_outer(dots).alias("at", "x"))
    rows = rows.select("row", id_col, F.when(F.coalesce("at", F.lit(0)) == 0, F.col("alone")).otherwise(0).alias("alone"), F.coalesce("x.type", F.concat(F.lit(_MARK), F.col("row").cast("string"))).alias("type"), F.coalesce("x.follows", F.lit("")).alias("follows"), F.coalesce("x.big", F.lit(False)).alias("big"))
    n = F.sum(F.greatest("alone", F.lit(0)) + F.coalesce("ends", F.lit(0))).cast("int")
    return rows.join(told, key, "left").groupBy("row", id_col).agg(n.alias("n_sentences")).drop("row")
