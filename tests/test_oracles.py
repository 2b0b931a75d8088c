"""Every query against its SQL; those without are run and looked at elsewhere."""

import pytest

import __spark_entry__ as entry
from acquimetra import catalog
from tests.compare import duck_rows, spark_rows

QUERIES = catalog.QUERIES
WITHOUT = {"fuzzy_match", "regional_clusters", "greedy_dedup", "stream_ingest"}


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(catalog.ORACLES) <= WITHOUT
    assert set(catalog.ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(duck, catalog.ORACLES[name])


def test_entry_names():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_lazy_and_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns and df.limit(1).count() == 1
