import os
import sys

import pytest

from conftest import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as ent  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

QUERIES = ent.queries()
SQL = ent.oracle_sql()


def test_entry_smoke(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["split", "trusted", "label", "n_mails", "clean_chars"]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 45


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, detail = compare(spark, con, QUERIES[name], SQL[name], SF001)
    assert ok, detail


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF001)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
