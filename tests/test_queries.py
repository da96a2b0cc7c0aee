"""Every query that SQL can express, against DuckDB on the same tables; the others at least run."""

import pytest
from conftest import rows_of

from plumbline.plans import asking, basics, clinic, extra, queries, relational  # noqa: F401 - they register their queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(name, spark, data_dir, duck):
    got = queries.QUERIES[name](spark, data_dir).toPandas()
    sql = queries.ORACLE_SQL.get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
