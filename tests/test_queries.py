"""Every registered query outside the llm subpackage against its SQL twin, or for rows where it has none."""

import pytest
from tests.conftest import SF, same

from gavel import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0 and not got.columns.has_duplicates


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
