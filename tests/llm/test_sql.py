"""Queries against their SQL on the smallest tables."""

import pytest
from compare import connect, differences

from civilspark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, small, name):
    assert differences(QUERIES[name](spark, small), connect(small), ORACLE[name]) is None
