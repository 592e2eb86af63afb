"""Every registered query with SQL against DuckDB, and every other one for rows, at the smallest scale."""

import pytest
from helpers import of_duck, of_spark

from cardpulse.plans.oracle import ORACLE_SQL
from cardpulse.plans.queries import QUERIES

SLOW = {"gbt_eval", "two_stage_eval", "gate_sweep", "lr_eval"}


def test_oracle_names_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(ORACLE_SQL) >= 50


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, duck, sf):
    assert of_spark(QUERIES[name](spark, sf)) == of_duck(duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
