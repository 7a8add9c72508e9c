"""Registered queries against their SQL twins on the smallest tables.

Set FOLIOSPARK_QUERIES to names separated by commas to compare only those.
"""

import os

import pytest

import __spark_entry__ as entry_point
from foliospark.plans import load_all
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = os.environ.get("FOLIOSPARK_QUERIES", "")
NAMES = CHOSEN.split(",") if CHOSEN else list(load_all()[0])


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql_and_the_names_agree():
    core = load_all()
    assert set(core[0]) == set(core[1]) and set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, message, _ = compare(spark, con, SF_DIR, entry_point.queries()[name], entry_point.oracle_sql()[name])
    assert ok, message


def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert {"query_id", "file_path", "score", "rank"} <= set(df.columns) and df.count() > 0
