"""Every registered query against its SQL twin on the smallest tables, and the driver's contract."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("p2_", "p3_"))))
def test_query_equals_sql(spark, name):
    got = compare(spark, BASE, name, entry.queries()[name], entry.oracle_sql()[name])
    assert got.startswith("ok"), got
