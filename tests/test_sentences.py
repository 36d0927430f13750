"""The trained sentence splitter: golden splits, and a model learned from a small collection."""

import random

import pytest
from pyspark.sql import functions as F

from corvid.analysis import sentences
from corvid.analysis.analyzer import Analyzer
from corvid.analysis.normalize import diacritics
from corvid.analysis.sentences import ABBREVIATION, SentenceModel, abbreviations

GOLDEN = SentenceModel(frozenset({"dr", "e.g", "etc", "st", "mr"}), frozenset({"the", "we"}), frozenset({"mr smith", "3 may"}), frozenset({"then", "we"}))
CASES = {
    "Dr. Brown met J. R. Smith in St. Louis. They talked.": ["Dr. Brown met J. R. Smith in St. Louis.", "They talked."],
    "Apples, pears etc. The rest is gone. etc. and so on": ["Apples, pears etc.", "The rest is gone.", "etc. and so on"],
    "He came (at last!) Then: why? Nobody knows...  no one. \n New line": ["He came (at last!)", "Then: why?", "Nobody knows...  no one.", "New line"],
    "Use fruit, e.g. Apples. Mr. Smith paid 3. May came. It cost 4. 5 more.": ["Use fruit, e.g. Apples.", "Mr. Smith paid 3. May came.", "It cost 4. 5 more."],
    "«Fin.» Étoile. ça va": ["«Fin.»", "Étoile.", "ça va"],
    "no end": ["no end"],
    " \n ": [],
    "": [],
}


def test_golden_splits(spark):
    rows = spark.createDataFrame([(t,) for t in [*CASES, None]], "text string").select("text", GOLDEN.split(F.col("text")).alias("s")).collect()
    assert {r.text: r.s for r in rows} == {**CASES, None: None}
    long = "word " * 50_000 + "end. " + "Next one. " * 3000
    assert len(spark.createDataFrame([(long,)], "text string").select(GOLDEN.split(F.col("text")).alias("s")).first().s) == 3001


@pytest.fixture(scope="module")
def collection(spark):
    rng = random.Random(1)
    nouns = [f"{a}{b}" for a in ("har", "mol", "ten", "gri", "pla") for b in ("vest", "ding", "kor", "sum", "tel")]
    sentence = lambda: " ".join([rng.choice(["The", "We", "However,"]), *(rng.choice(nouns) for _ in range(rng.randint(3, 7)))])
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(6):
            s = sentence()
            if rng.random() < 0.4:
                s += rng.choice([" by Prof. Miller in ", " at approx. ten ", " for Prof. Miller ", " with the "]) + rng.choice(nouns)
            parts.append(s + ".")
        texts.append(" ".join(parts))
    return spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string").repartition(4)


def test_learned_model(spark, collection):
    model = SentenceModel.train(collection)
    assert {"prof", "approx"} <= model.abbreviations and not model.abbreviations & {"harvest", "miller", "ten"}
    assert {"the", "we"} <= model.starters and "prof miller" in model.collocations
    assert model == SentenceModel.train(collection.repartition(7))
    text = "We saw Prof. Miller. The harvest was approx. ten. However, A. Miller left"
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(model.split(F.col("text")).alias("s")).first().s == ["We saw Prof. Miller.", "The harvest was approx. ten.", "However, A. Miller left"]
    an = Analyzer(tokenizer=model, do_lowercasing=False, do_acronyms_normalization=False, do_punctuation_removal=False)
    assert an.terms(df.withColumn("id", F.lit(1)), "id", "text").count() == 3
    scores = {r.word: r.score for r in abbreviations(collection).collect()}
    assert scores["prof"] >= ABBREVIATION > scores.get("harvest", 0)
    assert SentenceModel.train(collection.limit(0)) == SentenceModel()


def test_a_model_keeps_all_that_passes_the_bounds(spark, collection, monkeypatch):
    odd = ["Prof. Miller", "at approx. ten. The end", "  ", "no mark", "(one!) Two? Three... four", "Prof. Miller. \n", "? . !", "approx.", None, "J. R. The harvest. 3. may", "Prof. Miller"]
    docs = collection.union(spark.createDataFrame([(t,) for t in odd], "text string")).select(F.lit(1).alias("doc_id"), "text")
    model = SentenceModel.train(docs)
    want = sorted(r.n for r in docs.select(F.coalesce(F.size(model.split(F.col("text"))), F.lit(0)).alias("n")).collect())
    assert sorted(r.n_sentences for r in sentences.count_sentences(docs).collect()) == want
    # no more than one entry of a kind was kept before
    monkeypatch.setattr(sentences, "MOST", 1)
    assert SentenceModel.train(docs) == model and {"prof", "approx"} <= model.abbreviations
    got = sentences.count_sentences(docs)
    assert "Join" in str(got._jdf.queryExecution().optimizedPlan()) and sorted(r.n_sentences for r in got.collect()) == want
    by_text = sentences.count_sentences(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text"))
    texts = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    assert sorted(map(tuple, by_text.collect())) == sorted(map(tuple, texts.select("doc_id", F.coalesce(F.size(model.split(F.col("text"))), F.lit(0))).collect()))


def test_diacritics_are_transliterated(spark):
    cases = {"Straße Ærø Łódź naïve ﬁn": "Strasse Aero Lodz naive fin", "Москва, щука": "Moskva, shchuka", "Αθήνα ψυχή": "Athena psukhe", "Þór ıđ GROẞ": "Thor id GROSS", "plain 日本": "plain 日本", "объект Юла": "obekt Iula"}
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "text string").select("text", diacritics(F.col("text")).alias("t")).collect()
    assert {r.text: r.t for r in rows} == {**cases, None: None}


def test_patterns_are_asked_of_distinct_tokens(spark, collection):
    plan = abbreviations(collection)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Aggregate [token", 1)[1].split("\n", 1)[1].split("Aggregate [")[0]
    assert "posexplode" in below and "regexp_replace" not in below
    # a piece reaches to the next end mark, so words between are not looked at one by one
    text = "word " * 1000 + "end.  Next (one!) \n\n and.more words  "
    row = spark.createDataFrame([(text,)], "text string").select(GOLDEN.split(F.col("text")).alias("s")).first()
    assert [s[-9:] for s in row.s] == ["word end.", "xt (one!)", "ore words"]
