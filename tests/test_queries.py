import pytest

from marlstone.plans.registry import ORACLE, QUERIES
from tests.oracle import connect, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    assert rows, "a query that finds nothing checks nothing"
    if name in ORACLE:
        assert (names, rows) == sql_rows(connect(sf_dir), ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
