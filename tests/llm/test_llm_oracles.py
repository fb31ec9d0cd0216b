from __future__ import annotations

import pytest
from oracle_support import compare

from graphkiln.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], SMALL)
