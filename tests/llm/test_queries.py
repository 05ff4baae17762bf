"""Every registered training-data query: against its SQL twin where there is one, else that it runs on the smallest tables."""

import os

import pytest

from reqloom.llm import queries
from tests.compare import compare

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        got = compare(spark, BASE, name, queries.QUERIES[name], queries.SQL[name])
        assert got.startswith("ok"), got
    else:
        assert queries.QUERIES[name](spark, BASE).count() > 0
