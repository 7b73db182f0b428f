"""The queries of the subpackage that SQL can express, against DuckDB."""

import pytest

from tests.parity import compare, connect
from weftline.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, sf_dir, name):
    assert compare(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name]) > 0
