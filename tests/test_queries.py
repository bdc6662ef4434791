"""Every registered query that has SQL gives the same rows on DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from doctopics.plans import ORACLES, QUERIES, load_all
from tests.harness import difference, duck

load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    problem = difference(QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLES[name]).df())
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() == 40


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
