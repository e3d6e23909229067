import pytest

from tests.conftest import same_rows
from gridpile.plans import files, oracle, queries


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) & set(oracle.SQL)))
def test_equals_sql(name, spark, small, duck):
    same_rows(queries.QUERIES[name](spark, small), duck, oracle.SQL[name])


@pytest.mark.parametrize("name", sorted(files.QUERIES))
def test_files_equal_sql(name, spark, small, duck):
    same_rows(files.QUERIES[name](spark, small), duck, files.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_runs(name, spark, small):
    assert queries.QUERIES[name](spark, small).count() > 0 or name == "moran_hot_spots"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 24
    assert set(e.oracle_sql()) <= set(e.queries())
