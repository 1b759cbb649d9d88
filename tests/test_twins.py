"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from compare_tables import connect, differences

import __spark_entry__ as registry
from workload.oracle import oracle_sql
from workload.queries import QUERIES

TWINS = oracle_sql()


@pytest.fixture(scope="module")
def database(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_twin():
    assert sorted(QUERIES) == sorted(TWINS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, database, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), database, TWINS[name]) == []


def test_entry_runs(spark):
    result = registry.entry(spark)
    assert result.columns == ["start_date", "end_date", "themes", "quotes", "action_ideas", "note_markdown"]
