import pytest

from postlake.plans import account_queries, feed_queries, queries, report_queries, resume_queries, store_queries  # noqa: F401  all fill the same table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(same, name):
    same(queries.QUERIES[name], queries.SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
