"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest

from veilspan.plans import registry

registry.load_all()


@pytest.fixture(scope="module")
def duck(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, duck, name):
    df = registry.QUERIES[name](spark, folder)
    sql = registry.ORACLES.get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert oracle.compare(df, duck, sql) is None


def test_entry_point_lists_the_same_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 150
