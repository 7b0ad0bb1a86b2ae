from __future__ import annotations

import pytest
from sql import compare

from docketry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])
