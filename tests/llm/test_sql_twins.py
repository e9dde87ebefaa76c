"""Every operator's query that SQL can express, against its twin on the same tables."""

import pytest
from helpers import SF, same

from grainline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])
