import pytest
from compare import DATA, needs_data, rows_of_query, rows_of_sql

import __spark_entry__
from plyforge import catalog


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    assert rows_of_query(__spark_entry__.queries()[name](spark, str(DATA))) == rows_of_sql(catalog.SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - {"best_moves", "material_baseline"}))
def test_query_without_sql_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, str(DATA)).count() > 0


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 8
