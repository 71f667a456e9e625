"""Every registered query against its SQL, and the driver's entry points."""

import __spark_entry__ as entry_points
import pytest

from lorespark.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 1


def test_entry_points(spark):
    assert entry_points.entry(spark).columns == ["query_id", "doc_id", "rank", "score"]
    found = entry_points.queries()
    assert set(QUERIES) <= set(found) and set(entry_points.oracle_sql()) <= set(found)
