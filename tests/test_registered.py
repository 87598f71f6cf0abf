"""Registered queries against DuckDB on the smallest driver tables."""

import importlib
from pathlib import Path

import pytest

from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no driver tables")

# The others are run by checks.compare; these take the longest paths through the library.
SAMPLE = ["search_and", "search_segments", "chapter_view", "omni_search_rows", "queries_from_links"]


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)
    entry = importlib.import_module("__spark_entry__")
    # queries that SQL cannot express, such as trained models, have none and are tested by themselves
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, name):
    report = compare(spark, connect(SF_DIR), SF_DIR, name)
    assert f"{name}: ok" in report, report
