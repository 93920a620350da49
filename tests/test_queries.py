"""Every query against its SQL in DuckDB, or that it runs, on the smallest tables; no use of the training-data part."""

import pytest

from strandwork.plans.catalog import REGISTRY
from tests import compare
from tests.conftest import SMALL

WITH_SQL = sorted(REGISTRY.sql)
#: Queries whose filters leave nothing of the smallest tables.
MAY_BE_EMPTY = {"entity_relations", "related_person_edges", "components", "largest_component", "code_owner", "community_size_filter"}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, name):
    names, rows = compare.of_spark(REGISTRY.queries[name](spark, SMALL))
    assert (names, rows) == compare.of_duckdb(duck, REGISTRY.sql[name])
    assert rows or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_query_without_sql_runs_twice_alike(spark, name):
    a, b = (compare.of_spark(REGISTRY.queries[name](spark, SMALL)) for _ in range(2))
    assert a == b


def test_inventory_rows_are_numbers_of_the_inventory():
    rows = {n for r in REGISTRY.rows.values() for n in r}
    assert rows <= set(range(1, 298))


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(REGISTRY.queries) <= set(e.queries())
