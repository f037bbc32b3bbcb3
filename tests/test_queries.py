"""Every registered query with SQL against DuckDB; those without must give rows."""

import pytest
import spanforge.operators  # noqa: F401
import spanforge.plans.compilers  # noqa: F401
import spanforge.streaming.queries  # noqa: F401
from spanforge import registry

from .compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, con, name):
    same(registry.QUERIES[name](spark, SF), con, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
