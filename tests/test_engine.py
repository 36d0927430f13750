"""Golden scores, operators on small tables, and retrievers end to end."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.analysis import normalize as n
from corvid.analysis.analyzer import Analyzer
from corvid.analysis.stemmers import cistem, english, german, get_stemmer, porter, register_stemmer
from corvid.analysis.stopwords import get_stopwords, register_stopwords
from corvid.operators import blockmax, dense, evaluation, filters, fusion, scoring, sets, vector_index
from corvid.operators.index import build_index, persist_index
from corvid.operators.sampler import sample
from corvid.retrievers import AdvancedRetriever, DenseRetriever, HybridRetriever, Merger, SearchEngine, SparseRetriever
from corvid.sources.collections import IndexFolder, get_docs, import_embeddings, read_collection
from corvid.streaming.query_stream import stream_search

SHANE = ["Shane", "Shane C", "Shane P Connelly", "Shane Connelly", "Shane Shane Connelly Connelly", "Shane Shane Shane Connelly Connelly Connelly"]
GOLDEN = {
    (0.5, 0.0): ([0.07410797] * 6, [0.44183275] * 4),
    (0.0, 10.0): ([0.07410797] * 4 + [0.13586462, 0.18812023], [0.44183275] * 2 + [0.8100267, 1.1215755]),
    (1.0, 5.0): ([0.16674294, 0.10261103, 0.07410797, 0.10261103, 0.10261103, 0.10261105], [0.44183275] + [0.6117684] * 3),
}
SCHEMA = {"id": "id", "lyrics": "text", "year": "number", "ozzy": "bool", "album": "keyword", "genre": "keywords"}
SONGS = [
    ("doc_0", "Generals gathered in their masses", 1969, True, "Black Sabbath", ["Doom", "Heavy Metal"]),
    ("doc_1", "Just like witches at black masses", 1970, True, "Paranoid", ["Doom", "Heavy Metal"]),
    ("doc_2", "Evil minds that plot destruction", 1980, False, "Heaven and Hell", ["Heavy Metal"]),
]


@pytest.fixture(scope="module")
def shane(spark):
    return spark.createDataFrame([(k + 1, t) for k, t in enumerate(SHANE)], "id int, text string")


@pytest.fixture(scope="module")
def songs(spark):
    return spark.createDataFrame(SONGS, "id string, lyrics string, year long, ozzy boolean, album string, genre array<string>")


@pytest.mark.parametrize("setting", GOLDEN)
def test_golden_scores(spark, shane, setting):
    index = build_index(shane, id_col="id")
    asked = spark.createDataFrame([("q_1", "shane"), ("q_2", "connelly")], "q_id string, text string")
    run = scoring.search(index, asked, Analyzer(), b=setting[0], k1=setting[1]).collect()
    one, two = GOLDEN[setting]
    want = {("q_1", k + 1): s for k, s in enumerate(one)} | {("q_2", k + 3): s for k, s in enumerate(two)}
    got = {(r.q_id, r.doc_id): r.score for r in run}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1.5e-6) for k in want)


def test_normalisation(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(n.lowercase, "hEllO") == "hello" and one(n.ampersand, "black&sabbath") == "black and sabbath" and one(n.special_chars, "‘’") == "''"
    assert one(n.acronyms, "a.b.c.") == "abc" and one(n.acronyms, "foo.bar") == "foo.bar" and one(n.acronyms, "a.b@hello.com") == "a.b@hello.com"
    assert one(n.punctuation, "foo.bar?") == "foo bar " and one(n.collapse_spaces, " hello   world  ") == "hello world" and one(n.diacritics, "über") == "uber"
    assert one(n.wordpunct, "can't stop!") == ["can", "'", "t", "stop", "!"] and one(n.word, "I can't stop.") == ["I", "ca", "n't", "stop", "."] and one(n.sent, "One. Two!") == ["One.", "Two!"]


def test_stemmers_and_stopwords(spark):
    pairs = {"caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "hopping": "hop", "hoping": "hope", "generously": "generous", "relational": "relat", "very": "veri", "skies": "sky", "consignment": "consign", "knightly": "knight", "consistency": "consist", "national": "nation"}
    assert {w: english(w) for w in pairs} == pairs
    assert [porter(w) for w in ("caresses", "ponies", "relational", "hopping", "hopefulness")] == ["caress", "poni", "relat", "hop", "hope"]
    assert [german(w) for w in ("aufeinander", "häuser", "kategorischen", "jahre")] == ["aufeinand", "haus", "kategor", "jahr"]
    assert cistem("Speicherbehältern") == "speicherbehalt"
    assert get_stemmer(None) is None and get_stemmer(len) is len
    for bad in ("krovetz", "klingon"):
        with pytest.raises(NotImplementedError):
            get_stemmer(bad)
    register_stemmer("cut", lambda w: w[:3])
    assert get_stemmer("CUT")("abcdef") == "abc"
    assert get_stopwords(None) == frozenset() and get_stopwords(["a", "the"]) == {"a", "the"} and "the" in get_stopwords("english") and "der" in get_stopwords("german")
    with pytest.raises(NotImplementedError):
        get_stopwords("basque")
    register_stopwords("basque", ["eta"])
    assert get_stopwords("Basque") == {"eta"}
    # stop words are stemmed and compared with unstemmed tokens: "very" stays, as its stem is another word
    terms = Analyzer(stemmer="english", stopwords=["very", "the"]).terms(spark.createDataFrame([(1, "the very end")], "id int, text string"), "id", "text")
    assert sorted(r.term for r in terms.collect()) == ["end", "veri"]


def test_min_df_changes_lengths(spark, shane):
    index = build_index(shane, min_df=2, id_col="id")
    assert {r.term: r.df for r in index.term_stats.collect()} == {"shane": 6, "connelly": 4}
    assert {r.doc_id: r.doc_len for r in index.doc_stats.collect()}[2] == 1
    assert {r.term for r in build_index(shane, min_df=0.9, id_col="id").term_stats.collect()} == {"shane"}
    assert build_index(shane, min_df=100, id_col="id").doc_stats.where("doc_len > 0").count() == 0
    with pytest.raises(ValueError):
        build_index(shane, min_df=0)


def test_properties(spark, shane):
    index, a = build_index(shane, id_col="id"), Analyzer()
    ask = lambda t: spark.createDataFrame([("q", t)], "q_id string, text string")
    rows = lambda df: {(r.doc_id, r.score) for r in df.collect()}
    union, both = rows(scoring.search(index, ask("c connelly unknown"), a)), rows(scoring.search(index, ask("shane connelly unknown"), a, operator="AND"))
    assert {d for d, _ in both} == {3, 4, 5, 6} and both <= rows(scoring.search(index, ask("shane connelly"), a)) and {d for d, _ in union} == {2, 3, 4, 5, 6}
    single, double = dict(rows(scoring.search(index, ask("shane"), a))), dict(rows(scoring.search(index, ask("shane shane"), a)))
    assert all(math.isclose(2 * single[d], double[d], abs_tol=2e-6) for d in single)
    subset = spark.createDataFrame([(3,), (5,)], "doc_id int")
    assert rows(scoring.search(index, ask("shane"), a, subset=subset)) == {(d, s) for d, s in single.items() if d in (3, 5)}
    assert scoring.search(index, ask("zzz"), a).count() == 0


FILTERS = [
    ({"year": ("between", [1970, 1980])}, {1, 2}), ({"where_not": {"year": ("between", [1970, 1975])}}, {0, 2}), ({"genre": ("and", ["Doom", "Heavy Metal"])}, {0, 1}), ({"where_not": {"genre": ("or", ["Doom", "Heavy Metal"])}}, set()),
    ({"where_not": {"genre": ("and", ["Doom", "Heavy Metal"])}}, {2}), ({"genre": "Doom"}, {0, 1}), ({"ozzy": True}, {0, 1}), ({"where_not": {"ozzy": True}}, {2}), ({"album": ["Paranoid", "Heaven and Hell"]}, {1, 2}),
    ({"where_not": {"album": "Paranoid"}}, {0, 2}), ({"id": ["doc_1"]}, {1}), ({"id": "doc_1"}, {1}), ({"year": 1969}, {0}), ({"year": ("gte", 1970), "ozzy": True}, {1}), ({}, {0, 1, 2}), ({"where": {"ozzy": True}, "where_not": {"year": 1969}}, {1}),
]


@pytest.mark.parametrize("query, want", FILTERS)
def test_filters(songs, query, want):
    assert {r.id for r in filters.filter_documents(songs, SCHEMA, query).collect()} == {f"doc_{k}" for k in want}


def test_filter_and_its_negation_are_everything(songs):
    for query, _ in FILTERS:
        bare = {k: v for k, v in query.items() if not k.startswith("where")}
        for k, v in bare.items():
            a, b = (filters.filter_documents(songs, SCHEMA, q).count() for q in ({k: v}, {"where_not": {k: v}}))
            assert a + b == 3


def test_filter_errors(songs):
    for query in ({"nope": 1}, {"lyrics": "x"}, {"genre": ("xor", ["a"]), "year": ("like", 3)}):
        with pytest.raises(ValueError):
            filters.compile_query(query, SCHEMA)
    with pytest.raises(ValueError):
        filters.predicate(SCHEMA, "year", "should", 1)
    with pytest.raises(ValueError):
        filters.check_keyword(songs, "album", "Unknown")
    for bad in ({"a": "id", "b": "id"}, {"a": "text"}, {"a": "id", "b": "text", "c": "text"}):
        with pytest.raises(ValueError):
            filters.check_schema(bad)
    with pytest.raises(TypeError):
        filters.check_schema({"a": "id", "b": "date"})
    filters.check_collection(songs, SCHEMA)
    with pytest.raises(ValueError):
        filters.check_collection(songs.drop("year"), SCHEMA)
    with pytest.raises(ValueError):
        filters.check_collection(songs.withColumn("extra", F.lit(1)), SCHEMA)
    with pytest.raises(TypeError):
        filters.check_collection(songs.withColumn("ozzy", F.lit("yes")), SCHEMA)


def test_array_sets(spark):
    row = spark.createDataFrame([([1, 3, 4, 7], [1, 4, 7, 9], [[1, 2], [2, 3], [2, 9]], [0.1, 0.3, 0.2, 0.4])], "a array<int>, b array<int>, m array<array<int>>, s array<double>")
    a, b = F.col("a"), F.col("b")
    got = row.select(sets.array_union(a, b), sets.array_intersect(a, b), sets.array_difference(a, b), sets.array_union_multi(F.col("m")), sets.array_intersect_multi(F.col("m")), sets.array_concat(F.col("m")), sets.positions(a, F.array(F.lit(4), F.lit(1))), sets.array_top_k(F.col("s"), 2)).first()
    assert list(got) == [[1, 3, 4, 7, 9], [1, 4, 7], [3], [1, 2, 3, 9], [2], [1, 2, 2, 3, 2, 9], [2, 0], [3, 1]]


RUN_A = [("q1", "d1", 2.0), ("q1", "d2", 0.7), ("q1", "d3", 0.5), ("q2", "d1", 1.0), ("q2", "d2", 0.7), ("q2", "d3", 0.5)]
RUN_B = [("q1", "d3", 2.0), ("q1", "d1", 0.7), ("q2", "d1", 1.0), ("q2", "d2", 0.7), ("q2", "d3", 0.5)]


def test_norms_and_fusion(spark):
    a, b = (spark.createDataFrame(r, "q_id string, doc_id string, score double") for r in (RUN_A, RUN_B))
    got = lambda norm: {(r.q_id, r.doc_id): r.score for r in fusion.normalize(a, norm).collect()}
    assert math.isclose(got("min-max")["q1", "d2"], 0.2 / 1.5) and math.isclose(got("max")["q1", "d2"], 0.35) and math.isclose(got("sum")["q1", "d2"], 0.2 / (3.2 - 1.5))
    fused = {(r.q_id, r.doc_id): r.score for r in fusion.fuse([a, b]).collect()}
    assert math.isclose(fused["q1", "d1"], 1.0) and math.isclose(fused["q1", "d3"], 1.0) and math.isclose(fused["q2", "d1"], 2.0)
    flipped = {(r.q_id, r.doc_id): r.score for r in fusion.fuse([b, a]).collect()}
    assert fused == flipped
    assert [r.doc_id for r in fusion.fuse([a, b], cutoff=1).where("q_id = 'q1'").collect()] == ["d1"]
    alone = spark.createDataFrame([("q", "d", 3.0)], "q_id string, doc_id string, score double")
    assert fusion.normalize(alone, "min-max").first().score == 0.0
    with pytest.raises(ValueError):
        fusion.normalize(a, "rank")


def test_metrics(spark):
    run = spark.createDataFrame([("q1", 1, 1), ("q1", 2, 2), ("q1", 3, 3), ("q2", 9, 1)], "q_id string, doc_id int, rank int")
    qrels = spark.createDataFrame([("q1", 2, 1), ("q1", 3, 2), ("q2", 8, 1), ("q3", 5, 1), ("q1", 4, 0)], "q_id string, doc_id int, rel int")
    value = lambda m: evaluation.evaluate(run, qrels, m).first().value
    assert math.isclose(value("mrr"), 0.5 / 3, abs_tol=1e-6) and math.isclose(value("recall@2"), 0.5 / 3, abs_tol=1e-6) and math.isclose(value("map"), (1 / 2 + 2 / 3) / 2 / 3, abs_tol=1e-6)
    ideal = 2 + 1 / math.log2(3)
    assert math.isclose(value("ndcg"), (1 / math.log2(3) + 2 / 2) / ideal / 3, abs_tol=1e-5) and value("hits") == pytest.approx(2 / 3, abs=1e-6)
    with pytest.raises(ValueError):
        value("charm")


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(k, x[k].tolist()) for k in range(10)], "q_id long, vector array<double>")
    want = {(q, d) for q in range(10) for d in np.argsort(-(x @ x[q]), kind="stable")[:10].tolist()}
    pairs = lambda run: {(r.q_id, r.doc_id) for r in run.collect()}
    assert pairs(dense.exact_top_k(docs, asked, 10)) == want
    assert dense.exact_top_k(docs, asked.limit(0), 10).count() == 0
    assert len(pairs(_filed(docs, asked, 10)) & want) >= 90 and len(pairs(dense.lsh_top_k(docs, asked, 10)) & want) >= 90
    unit = docs.select(dense.normalized(F.transform("vector", lambda v: v * 3)).alias("v")).first().v
    assert math.isclose(sum(v * v for v in unit), 1.0)


def test_hashing_finds_the_best_of_what_shares_a_bucket(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(3000, 8)), 2)
    x[7::500] = x[7]  # ties go to the smaller id
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(-1, None)], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(f"q{k}", x[k].tolist()) for k in range(0, 60, 7)], "q_id string, vector array<double>")
    run = dense.lsh_top_k(docs, asked, 10, tables=3, bits=4, seed=1)
    code = ((x @ np.random.default_rng(1).normal(size=(8, 12))) > 0).reshape(len(x), 3, 4) @ (1 << np.arange(4))
    want = set()
    for q in range(0, 60, 7):
        close = np.round(x @ x[q], 6)
        met = np.flatnonzero((code == code[q]).any(1))
        assert 10 < len(met) < len(x) / 2
        want |= {(f"q{q}", int(d), float(close[d]), r + 1) for r, d in enumerate(met[np.lexsort((met, -close[met]))][:10])}
    assert {(r.q_id, r.doc_id, r.score, r.rank) for r in run.collect()} == want
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # pairs of query and document were rows of a join before


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_registered_ann_recall(spark, size):
    from corvid.plans import queries

    d = f"/root/testdata/{size}"
    docs, asked = queries._vectors(spark, d)
    pairs = lambda run: {(r.q_id, r.doc_id) for r in run.select("q_id", "doc_id").collect()}
    want = pairs(dense.exact_top_k(docs, asked, 10))
    for name in ("ann_ivf", "ann_lsh"):
        found = len(pairs(queries.QUERIES[name](spark, d)) & want) / len(want)
        print(name, size, round(found, 3))
        assert found >= 0.9


def test_encode_reads_whole_texts(spark, tmp_path):
    from corvid.plans import queries

    rows = [(k, "same " * 128 + tail) for k, tail in enumerate(("apple pear", "iron copper zinc"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    vectors = {r.doc_id: r.vector for r in queries.QUERIES["encode_texts"](spark, str(tmp_path)).collect()}
    assert vectors[0] != vectors[1]
    a, b = DenseRetriever(spark, "w", str(tmp_path)).encoder([t for _, t in rows])
    assert (a != b).any()


def test_sources(spark, tmp_path, songs):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "one"}\n{"id": "2", "text": "two"}\n')
    (tmp_path / "a.csv").write_text("id,text\n1,one\n2,two\n")
    (tmp_path / "a.tsv").write_text("id\ttext\n1\tone\n2\ttwo\n")
    for kind in ("jsonl", "csv", "tsv"):
        assert {(r.id, r.text) for r in read_collection(spark, str(tmp_path / f"a.{kind}")).select("id", "text").collect()} == {("1", "one"), ("2", "two")}
    upper = read_collection(spark, str(tmp_path / "a.csv"), callback=lambda r: {"id": int(r["id"]), "text": r["text"].upper()}, callback_schema="id long, text string")
    assert {(r.id, r.text) for r in upper.collect()} == {(1, "ONE"), (2, "TWO")}
    with pytest.raises(ValueError):
        read_collection(spark, "a.xml")
    assert [r.id for r in get_docs(songs, ["doc_2", "doc_0"], "id").collect()] == ["doc_2", "doc_0"]
    np.save(tmp_path / "v.npy", np.eye(3))
    assert {(r.id, tuple(r.vector)) for r in import_embeddings(spark, str(tmp_path / "v.npy"), spark.range(10, 13), "id").collect()} == {(10, (1, 0, 0)), (11, (0, 1, 0)), (12, (0, 0, 1))}


def test_embeddings_follow_the_collection(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(12.0).reshape(6, 2))
    for ids, kind in (([30, 10, 20, 5, 50, 40], "long"), (["doc_10", "doc_2", "b", "a", "zz", "c"], "string")):
        spark.createDataFrame([(i,) for i in ids], f"id {kind}").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "ids"))
        for table in (spark.read.parquet(str(tmp_path / "ids")), spark.createDataFrame([(i,) for i in ids], f"id {kind}")):
            assert {r.id: list(r.vector) for r in import_embeddings(spark, str(tmp_path / "v.npy"), table, "id").collect()} == {i: [2.0 * k, 2 * k + 1] for k, i in enumerate(ids)}
    assert {r.doc_id for r in import_embeddings(spark, str(tmp_path / "v.npy")).collect()} == set(range(6))
    with pytest.raises(ValueError):
        import_embeddings(spark, str(tmp_path / "v.npy"), spark.range(5), "id")


def test_a_query_reads_only_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"common word{k} word{k % 7}") for k in range(3000)], "id long, text string")
    r = SparseRetriever(spark, "pruned", str(tmp_path), stemmer=None, stopwords=None).index(docs)
    plan = scoring.search(scoring.only_terms(r.tables, scoring.few_terms(spark.createDataFrame([("q", "word12 word3")], "q_id string, text string"), r.analyzer)), spark.createDataFrame([("q", "word12 word3")], "q_id string, text string"), r.analyzer)
    told = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in told and "EqualTo(term,word12)" in told and "EqualTo(term,word3)" in told
    want = scoring.search(r.tables, spark.createDataFrame([("q", "word12 word3")], "q_id string, text string"), r.analyzer)
    assert [tuple(x) for x in r.msearch("word12 word3").orderBy("rank").collect()] == [tuple(x) for x in want.orderBy("rank").collect()]
    many = " ".join(f"word{k}" for k in range(300))
    assert scoring.few_terms(spark.createDataFrame([("q", many)], "q_id string, text string"), r.analyzer) is None and r.msearch(many, 1000).count() > 290


def _filed(docs, asked, k):
    model = vector_index.train(docs)
    return vector_index.search(vector_index.lists(docs, model), model, asked, k)


def test_distances_to_many_cells_are_held_in_small_blocks():
    import tracemalloc

    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(3000, 8)), rng.normal(size=(2048, 8))
    tracemalloc.start()
    near, far = vector_index.nearest(x, c)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = ((x[:50, None] - c) ** 2).sum(2)
    assert most < 20e6  # 50 MB before, in each of an executor's workers
    assert (near[:50] == d.argmin(1)).all() and np.allclose(far[:50], d.min(1))


def test_vector_index_scores_few_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(60, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(60, 16)) for c in centre] + [centre[:1].repeat(1200, 0) + 1e-3 * rng.normal(size=(1200, 16)), centre[1:2].repeat(300, 0)])  # a crowd, and copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(vector_index, "SHARD", 100)
    docs = spark.createDataFrame([(f"d{k}", v.tolist()) for k, v in enumerate(x)] + [("none", None)], "doc_id string, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 3600, 40)], "q_id long, vector array<double>")
    model = vector_index.train(docs)
    filed = vector_index.lists(docs, model).cache()
    assert filed.count() == len(x) and max(model.shards) > 1 and vector_index.Model.loads(model.dumps()) == model
    want, got = ({(r.q_id, r.score) for r in run.collect()} for run in (dense.exact_top_k(docs, asked, 10), vector_index.search(filed, model, asked, 10)))
    assert len(want & got) >= 0.9 * len(want)
    met = vector_index.scan(filed, model, asked, 10).agg(F.sum("met"), F.sum("scored")).first()
    assert met[1] <= met[0] <= 0.2 * len(x) * 90 and met[1] < 0.1 * len(x) * 90
    exact = {(r.q_id, r.doc_id): r.score for r in dense.exact_top_k(docs, asked, 5000).collect()}
    assert all(exact[r.q_id, r.doc_id] == r.score for r in vector_index.search(filed, model, asked, 10).collect())
    filed.unpersist()
    none = docs.limit(0)
    assert _filed(none, asked, 3).count() == 0


def test_an_index_comes_back_as_it_was(spark, tmp_path):
    base, rows = str(tmp_path), [{"id": 1, "text": "Alpha beta"}, {"id": 2, "text": "gamma delta beta"}, {"id": 3, "text": "alphas"}]
    for options in ({"dim": 128}, {"max_length": 1}, {"dim": 8, "use_ann": False, "normalize": False}):
        made = DenseRetriever(spark, "d", base, **options).index(rows)
        back = DenseRetriever.load(spark, "d", base)
        assert [tuple(r) for r in made.search("alpha beta").collect()] == [tuple(r) for r in back.search("alpha beta").collect()]
    own = lambda texts: [np.array([len(t), 1.0]) for t in texts]
    made = HybridRetriever(spark, "h", base, SparseRetriever(spark, "h-sparse", base, stemmer=lambda w: w[:4], stopwords=None), DenseRetriever(spark, "h-dense", base, own)).index(rows)
    with pytest.raises(ValueError, match="stemmer"):
        HybridRetriever.load(spark, "h", base, own)
    with pytest.raises(ValueError, match="model"):
        HybridRetriever.load(spark, "h", base, stemmer=lambda w: w[:4])
    back = HybridRetriever.load(spark, "h", base, own, stemmer=lambda w: w[:4])
    assert [tuple(r) for r in made.search("alphabet").collect()] == [tuple(r) for r in back.search("alphabet").collect()]
    split = SparseRetriever(spark, "s", base, tokenizer=lambda t: t.split("|"), stemmer=None, stopwords=None).index([{"id": 1, "text": "a b|c"}])
    with pytest.raises(ValueError, match="tokenizer"):
        SparseRetriever.load(spark, "s", base)
    back = SparseRetriever.load(spark, "s", base, tokenizer=lambda t: t.split("|"))
    assert split.search("a b", return_docs=False).count() == back.search("a b", return_docs=False).count() == 1
    schema = {"id": "id", "year": "number"}
    AdvancedRetriever(spark, schema, "plain", base).index(spark.createDataFrame([("a", 1990), ("b", 2000)], "id string, year long"))
    assert [r.id for r in AdvancedRetriever.load(spark, "plain", base).search({"where": {"year": ("gt", 1995)}}).collect()] == ["b"]


def test_a_conjunction_starts_from_its_rarest_term(spark, tmp_path):
    docs = spark.createDataFrame([(k, "common " * (k % 3 + 1) + f"word{k % 7} word{k % 50}") for k in range(700)], "id long, text string")
    asked = spark.createDataFrame([("a", "common word3 word33"), ("b", "word40 common"), ("c", "common nowhere"), ("d", "nowhere")], "q_id string, text string")
    written = persist_index(docs, str(tmp_path / "i"), id_col="id", block=16)
    terms = scoring.query_terms(asked, Analyzer())
    for index in (written, build_index(docs, id_col="id")):
        df = {r.term: r.df for r in index.term_stats.collect()}
        rows = {r.q_id: r.n for r in scoring.conjunction(index, terms).groupBy("q_id").agg(F.count("*").alias("n")).collect()}
        assert rows["a"] <= 3 * df["word33"] and rows["b"] <= 2 * df["word40"] and rows["c"] == df["common"] and "d" not in rows
        got = {(r.q_id, r.doc_id) for r in scoring.search(index, asked, Analyzer(), operator="AND", cutoff=1000).collect()}
        assert got == {("a", k) for k in range(700) if {k % 7, k % 50} >= {3, 33}} | {("b", k) for k in range(700) if k % 50 == 40} | {("c", k) for k in range(700)}


def test_sampler_finds_what_the_grid_finds():
    shape = lambda p: round(1 - abs(p["b"] - 0.37) - 0.05 * abs(p["k1"] - 4.3), 9)
    axes = {"b": [x / 100 for x in range(101)], "k1": [x / 10 for x in range(101)]}
    one, two = (sample(axes, lambda points: list(map(shape, points))) for _ in range(2))
    assert one == two and len(one) == 100 and len({tuple(p.values()) for p, _ in one}) == 100
    assert one[0][1] >= max(shape({"b": x / 10, "k1": y / 2}) for x in range(11) for y in range(21))
    small = sample({"kind": ["a", "b"], "x": [1, 2, 3]}, lambda points: [p["x"] + (p["kind"] == "b") for p in points], trials=50, batch=4)
    assert len(small) == 6 and small[0] == ({"kind": "b", "x": 3}, 4)


def test_sampled_parameters(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words[: rng.randint(3, 40)]) for _ in range(rng.randint(3, 120))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(str(k), " ".join(rng.sample(texts[k].split(), 3))) for k in range(12)], "q_id string, text string")
    qrels = spark.createDataFrame([(str(k), k, 1) for k in range(12)], "q_id string, doc_id long, rel int")
    r = SparseRetriever(spark, "sampled", str(tmp_path), stemmer=None, stopwords=None).index(docs)
    tried = [tuple(x) for x in r.autotune(asked, qrels, "mrr", trials=40).collect()]
    assert tried == [tuple(x) for x in r.autotune(asked, qrels, "mrr", trials=40).collect()] and len(tried) == 40
    grid = r.autotune(asked, qrels, "mrr", bs=[x / 5 for x in range(6)], k1s=[0.0, 0.5, 1.0, 2.0, 10.0])
    assert grid.count() == 30 and tried[0][2] >= grid.first().value - 0.02
    b, k1, value = tried[0]
    again = scoring.search(r.tables, asked, r.analyzer, b=b, k1=k1)
    assert abs(evaluation.evaluate(again, qrels, "mrr").first().value - value) < 2e-6


def _search_both(index, asked, analyzer, *options):
    return ([tuple(r) for r in scoring.search(index, asked, analyzer, *options, prune=p).select("q_id", "doc_id", "score", "rank").orderBy("q_id", "rank").collect()] for p in (False, True))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_bounds_leave_the_same_rows(spark, tmp_path, kind):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 80)]) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(700)] + [None, "w1 w1"]
    docs = spark.createDataFrame([(str(k) if kind == "string" else k, t) for k, t in enumerate(texts)], f"id {kind}, text string")
    index = persist_index(docs, str(tmp_path / "i"), Analyzer(), id_col="id", block=16)
    asked = spark.createDataFrame([("a", "w1 w70 w71 w1"), ("b", "w79"), ("c", "none"), ("d", " ".join(words)), ("e", "w1 w2 w3")], "q_id string, text string")
    for options in (("bm25", 0.75, 1.2, 10), ("bm25", 0.0, 3.0, 3), ("bm25", 1.0, 0.4, 100), ("tf-idf", 0.75, 1.2, 7), ("bm25", 0.75, 1.2, 2000)):
        plain, pruned = _search_both(index, asked, Analyzer(), *options)
        assert plain == pruned and plain


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_bounds_leave_out_half_of_the_postings(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    asked = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select(F.col("item_id").alias("q_id"), "text")
    index = persist_index(docs, str(tmp_path / "i"))
    terms = scoring.query_terms(asked, Analyzer())
    scanned, _, second = blockmax.passes(index, terms, 100)
    scored = sum(x.agg(F.sum("scored")).first()[0] or 0 for x in (scanned, second))
    assert 0 < scored <= blockmax.postings_of(index, terms) / 2


def test_a_written_index_needs_no_document_table_to_score(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"common word{k % 7}") for k in range(300)], "id long, text string")
    r = SparseRetriever(spark, "lens", str(tmp_path), stemmer=None, stopwords=None).index(docs)
    asked = spark.createDataFrame([("q", "word3 common")], "q_id string, text string")
    told = scoring.search(r.tables, asked, r.analyzer)._jdf.queryExecution().executedPlan().toString()
    assert "lens:array" in told and "rel_len:double" not in told  # columns that the scans read
    told = r.msearch(asked)._jdf.queryExecution().executedPlan().toString()  # a table of few queries prunes too
    assert "EqualTo(term,word3)" in told


def test_words_are_stemmed_after_they_are_counted(spark, tmp_path):
    docs = spark.createDataFrame([(1, "running runs the ran"), (2, "run running runner"), (3, None), (4, "the")], "id long, text string")
    an = Analyzer(stemmer="english", stopwords="english")
    made, kept = build_index(docs, an, id_col="id"), SparseRetriever(spark, "stems", str(tmp_path)).index(docs).tables
    for name in ("postings", "term_stats", "doc_stats", "totals"):
        assert sorted(map(tuple, getattr(made, name).collect())) == sorted(map(tuple, getattr(kept, name).collect()))
    assert {(r.term, r.doc_id): r.tf for r in kept.postings.collect()} == {("run", 1): 2, ("ran", 1): 1, ("run", 2): 2, ("runner", 2): 1}


def test_sparse_retriever(spark, shane, tmp_path):
    base = str(tmp_path)
    SearchEngine(spark, "shane", base, stopwords=None, b=0.5, k1=0.0).index(shane)
    r = SparseRetriever.load(spark, "shane", base)
    assert r.config.b == 0.5 and [x.id for x in r.search("connelly", cutoff=2).collect()] == [3, 4]
    assert r.search("zzz").count() == 0 and r.search("shane", return_docs=False).columns == ["q_id", "doc_id", "score", "rank"]
    asked = [{"id": "q_1", "text": "shane"}, {"id": "q_2", "text": "nothing"}]
    qrels = spark.createDataFrame([("q_1", 6, 1)], "q_id string, doc_id int, rel int")
    r.bsearch(asked, qrels=qrels, path=f"{base}/out")
    lines = sorted((json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()), key=lambda x: x["q_id"])
    assert lines[0]["sparse_doc_ids"] == [1, 2, 3, 4, 5, 6] and lines[0]["rel_doc_ids"] == [6] and "sparse_doc_ids" not in lines[1]
    tried = r.autotune(asked, qrels, "mrr", bs=[0.0, 1.0], k1s=[0.0, 10.0])
    assert tried.count() == 4 and (r.config.b, r.config.k1) == (0.0, 10.0) and SparseRetriever.load(spark, "shane", base).config.k1 == 10.0
    assert r.delete() and not r.delete() and not IndexFolder(spark, base, "shane").exists()
    for bad in ({"model": "lm"}, {"min_df": 0}):
        with pytest.raises(ValueError):
            SparseRetriever(spark, **bad)


def test_advanced_retriever(spark, songs, tmp_path):
    AdvancedRetriever(spark, SCHEMA, "songs", str(tmp_path)).index(songs)
    r = AdvancedRetriever.load(spark, "songs", str(tmp_path))
    ids = lambda *a, **k: {x.id for x in r.search(*a, **k).collect()}
    assert ids("witches masses") == {"doc_0", "doc_1"} and ids("witches masses", operator="AND") == {"doc_1"}
    assert ids({"text": "witches masses", "where": {"year": ("gte", 1970)}}) == {"doc_1"} and ids({"text": "witches masses", "where_not": {"album": "Paranoid"}}) == {"doc_0"}
    assert ids({"where": {"ozzy": True}}) == {"doc_0", "doc_1"} and ids({"text": "zzz", "ozzy": True}) == {"doc_0", "doc_1"} and ids("masses", subset_doc_ids=["doc_1", "doc_2"]) == {"doc_1"}
    assert {x.score for x in r.search({"ozzy": True}, cutoff=1).collect()} == {1.0} and ids({"text": "masses"}) == {"doc_0", "doc_1"}
    for back in (True, False):
        found = r.search({"ozzy": True}, return_docs=back)
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        assert [(x.q_id, x["id" if back else "doc_id"], x.score, x["rank"]) for x in found.collect()] == [("q", "doc_0", 1.0, 1), ("q", "doc_1", 1.0, 1)]
    assert ids({"album": "Unknown"}) == set() and r.filter_docs({"album": "Paranoid"}, strict=True).count() == 1
    with pytest.raises(ValueError):
        r.search({"album": "Unknown"}, strict=True)
    Merger("sum", [0.3, 0.7]).save(spark, "m", str(tmp_path))
    assert Merger.load(spark, "m", str(tmp_path)) == Merger("sum", [0.3, 0.7])


def test_dense_and_hybrid(spark, songs, tmp_path):
    docs = songs.select("id", F.col("lyrics").alias("text"))
    for ann in (False, True):
        DenseRetriever(spark, "d", str(tmp_path), use_ann=ann).index(docs)
        r = DenseRetriever.load(spark, "d", str(tmp_path))
        assert r.search("evil minds that plot", cutoff=1).first().id == "doc_2"
    h = HybridRetriever(spark, "h", str(tmp_path), stopwords=None).index(docs)
    assert h.search("witches at black masses", cutoff=1).first().id == "doc_1"
    assert HybridRetriever.load(spark, "h", str(tmp_path)).msearch([{"id": "a", "text": "generals"}], 1).first().doc_id == "doc_0"
    qrels = spark.createDataFrame([("a", "doc_0", 1)], "q_id string, doc_id string, rel int")
    assert h.merger.autotune(h._runs([{"id": "a", "text": "generals"}]), qrels).first().value == 1.0


def test_exact_dense_answers_every_query(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    made = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    r = DenseRetriever(spark, "many", str(tmp_path), use_ann=False).index(docs, embeddings=made)
    asked = spark.range(10_050).select(F.concat(F.lit("q"), "id").alias("q_id"), F.array(F.lit(1.0), F.lit(1.0)).alias("vector"))
    got = r.msearch(asked, 1)
    assert got.count() == got.select("q_id").distinct().count() == 10_050 and {x.doc_id for x in got.collect()} == {"a"}


def test_query_stream(spark, shane, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("q_1", "connelly")], "q_id string, text string").write.mode("overwrite").json(str(tmp_path / "in"))
    asked = spark.readStream.schema("q_id string, text string").json(str(tmp_path / "in"))
    seen = []
    q = stream_search(asked, build_index(shane, id_col="id"), Analyzer(), lambda run, k: seen.extend(r.doc_id for r in run.collect()), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [3, 4, 5, 6]
