"""Every query of the library that SQL can express, against DuckDB."""

import pytest

from tests.conftest import TESTDATA
from tests.oracle import check
from tidemark import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], TESTDATA)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    registry.queries()[name](spark, TESTDATA).count()
