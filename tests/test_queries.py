"""Every registered query against its oracle on the smallest tables."""

import pytest

from eqspark.plans import catalog

from .oracle import DATA, connection, rows

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["a3_preamp", "a4_graphic_eq", "f5_magnitude_expanded", "f21_smoothing_spline", "k10_graphic_text", "t3_record_history", "t10_edit_log", "i52_research_plan"])
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
