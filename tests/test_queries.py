"""Every query runs against its SQL twin."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from estuary.plans import registry
from tests.oracle import duck_rows, spark_rows


@pytest.fixture(scope="module")
def answers(request, spark, small):
    """The rows of the queries under test, several at a time, as most of them wait for the planner."""
    asked = (getattr(item, "callspec", None) for item in request.session.items if item.module is request.module)
    queries = registry.queries()
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(lambda q: spark_rows(q(spark, small)), queries[name]) for name in sorted(c.params["name"] for c in asked if c)}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(answers, small, name):
    assert answers[name].result() == duck_rows(registry.oracle_sql()[name], small)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
