"""Every query of the engine against its DuckDB oracle."""

import pytest

from tests.parity import compare, connect
from weftline.queries import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        compare(df, con, registry.ORACLES[name])
    else:
        assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
