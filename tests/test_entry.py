"""The registered queries against their SQL, at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles

SF_DIR = "/root/testdata/sf0.001"
# Queries of the subpackage for training data have tests of their own.
NAMES = [n for n in check_oracles.entry.queries() if n != "pipeline" and not n.startswith("op")]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return check_oracles.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    n_rows, problem = check_oracles.compare(spark, duck, SF_DIR, name)
    assert problem is None and n_rows > 0


def test_every_query_has_sql_and_whole_inputs():
    assert set(NAMES) <= set(check_oracles.entry.oracle_sql())


def test_flagship(spark):
    df = check_oracles.entry.entry(spark)
    assert df.columns == ["root", "url", "depth", "rank", "n_links", "title", "text_length"]
