"""The driver's contract, on the smallest tables where they are at hand."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

DIR = "/root/testdata/sf0.001"
NAMES = ["tokenize_counts", "bm25_msearch_topk", "bm25_and", "tfidf_msearch", "filter_where_and_not", "dense_exact_topk", "hybrid_msearch", "metric_ndcg_at_10"]
there = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@there
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], DIR) == ""


@there
def test_entry(spark):
    assert entry.entry(spark).columns == ["q_id", "doc_id", "score", "rank"]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_optional_subpackage():
    code = "import sys; sys.modules['corvid.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'bm25_and' in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env={**os.environ, "PYTHONPATH": root})
