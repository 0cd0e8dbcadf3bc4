"""Every registered time-series query against its SQL, and those without SQL for rows and schema."""

import pytest

from tideflow.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, same_rows, name):
    same_rows(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert 0.5 < row["slope_k2"] < 1.5
    assert set(e.oracle_sql()) <= set(e.queries())
