"""The learned encoder: its decomposition against numpy's, pooling against a plain loop, storing, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from corvid.analysis.analyzer import Analyzer
from corvid.operators import tasks, term_vectors
from corvid.operators.term_vectors import TermVectors, encode, learn, pool, vocabulary
from corvid.retrievers import DenseRetriever

TOPICS = ["river water boat fish net lake shore", "court judge law trial plea jury appeal", "oven bread flour yeast dough crust bake"]


def collection(n=300, seed=3):
    """Texts of one topic each, with words that all share."""
    rng = np.random.default_rng(seed)
    return [(k, " ".join(rng.choice(TOPICS[k % 3].split() + ["the", "and"], rng.integers(4, 30)))) for k in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(collection(), "doc_id long, text string")


def table_of(rows, terms):
    """The tf-idf table by plain loops."""
    counts = np.array([[text.split().count(t) for t in terms] for _, text in rows], float)
    weighted = counts * np.log((1 + len(rows)) / (counts > 0).sum(0))
    return weighted / np.maximum(1e-300, np.sqrt((weighted**2).sum(1)))[:, None]


def test_the_leading_singular_vectors_are_found(docs):
    model = learn(docs, dim=3, rounds=12)
    x = table_of(collection(), model.terms)
    _, _, right = np.linalg.svd(x, full_matrices=False)
    want = x @ right[:3].T
    got = np.array([r.vector for r in encode(docs, model, normalize=False).orderBy("doc_id").collect()])
    unit = lambda v: v / np.sqrt((v**2).sum(1))[:, None]
    assert np.allclose(unit(got) @ unit(got).T, unit(want) @ unit(want).T, atol=1e-5)


def test_partitions_and_batches_change_nothing(docs, monkeypatch):
    one, many = learn(docs.repartition(1), dim=5), learn(docs.repartition(7), dim=5)
    assert one.terms == many.terms and (one.vectors == many.vectors).all()
    row = np.repeat(np.arange(50), np.arange(50) % 7)
    monkeypatch.setattr(term_vectors, "HELD", 30)
    parts = [(p, s) for p, s in term_vectors.by_row(row, 5)]
    assert [k for p, _ in parts for k in range(p.start, p.stop)] == list(range(len(row)))
    assert all(len({*row[p]}) == len(s) and (np.diff(row[p], prepend=-1)[s] > 0).all() for p, s in parts)


def test_words_of_a_topic_are_near_though_they_never_meet(spark):
    """`boat` and `ship` share no text, but the words around them."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join([*rng.choice(TOPICS[k % 3].replace("boat ", "").split(), 8), *(["boat"] if k % 6 == 0 else ["ship"] if k % 6 == 3 else [])])) for k in range(300)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string"), dim=3)
    asked = spark.createDataFrame([(0, "boat"), (1, "ship"), (2, "jury")], "doc_id long, text string")
    a, b, c = (np.array(r.vector) for r in encode(asked, model).orderBy("doc_id").collect())
    assert a @ b > 0.9 and abs(a @ c) < 0.3


def test_pooling_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    model = TermVectors(["a", "b", "ç"], rng.normal(size=(3, 4)))
    rows = [(1, ["a", "b", "a", "x"]), (2, None), (3, []), (4, ["x", "y"]), (5, ["x", "x", "ç"]), (6, ["b"] * 70_000 + ["a"]), (6, ["ç"])]
    for limit in (None, 2):
        for normalize in (True, False):
            got = pool(spark.createDataFrame(rows, "doc_id long, tokens array<string>").coalesce(1), model, max_length=limit, normalize=normalize).collect()
            for (k, tokens), r in zip(rows, got, strict=True):
                known = [model.vectors[model.terms.index(t)] for t in (tokens or [])[:limit] if t in model.terms]
                want = np.mean(known, axis=0) if known else np.zeros(4)
                want = want / np.linalg.norm(want) if normalize and known else want
                assert r.doc_id == k and np.allclose(r.vector, want, atol=1e-9)


def test_odd_collections(spark):
    schema = "doc_id string, text string, tokens int, vector string"
    empty = learn(spark.createDataFrame([], schema), dim=4)
    assert empty.terms == [] and empty.vectors.shape == (0, 4)
    rows = [("a", None, 1, "z"), ("b", "", 1, "z"), ("c", "only once", 1, "z"), ("c", "two words", 1, "z"), ("d", "two words", 1, "z")]
    odd = spark.createDataFrame(rows, schema)
    assert all(r.vector == [0.0] * 4 for r in encode(odd, empty).collect())
    model = learn(odd, dim=4)  # fewer terms than dimensions, and of rank one
    assert model.terms == ["two", "words"] and (model.vectors[:, 1:] == 0).all()
    got = encode(odd, model)
    assert got.columns == ["doc_id", "vector"] and [(r.doc_id, round(r.vector[0], 6)) for r in got.collect()] == [("a", 0), ("b", 0), ("c", 0), ("c", 1), ("d", 1)]


def test_a_batch_is_worked_on_by_its_tokens(monkeypatch):
    # a batch of 10,000 texts was one piece before, however long they were
    monkeypatch.setattr(tasks, "TOKENS", 10)
    lists = [["a"] * 4, None, ["b"] * 6, ["c"], [], ["d"] * 25, None, ["e"] * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], ["id", "tokens"])
    parts = list(tasks.by_tokens([batch.slice(0, 0), batch, batch.slice(2, 4)], 1))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3, 4], [5], [6, 7], [2, 3, 4], [5]]
    assert [x for p in parts[:4] for x in p.column(1).to_pylist()] == lists


def test_vocabulary_is_bounded_and_ties_go_by_term(docs):
    rows = vocabulary(docs, Analyzer(), size=4).collect()
    every = sorted(((-sum(t in text.split() for _, text in collection()), t) for t in {w for _, text in collection() for w in text.split()}))
    assert [(-r.df, r.term) for r in rows] == every[:4]


def test_a_learned_encoder_is_stored_with_the_index(spark, docs, tmp_path):
    base = str(tmp_path)
    made = DenseRetriever(spark, "svd", base, model="svd", dim=8, max_length=10, use_ann=False).index(docs.withColumnRenamed("doc_id", "id"))
    asked = [{"id": "q", "text": "trial and jury"}, {"id": "r", "text": "nothing known"}]
    before = made.msearch(asked, 5).collect()
    back = DenseRetriever.load(spark, "svd", base)
    assert back.msearch(asked, 5).collect() == before and back.max_length == 10 and (back.encoder.vectors == made.encoder.vectors).all()
    assert {r.doc_id % 3 for r in before if r.q_id == "q"} == {1}
    assert not (tmp_path / "collections" / "svd" / "rows").exists()
    with pytest.raises(ValueError):
        DenseRetriever(spark, "other", base, model="unknown")
