"""The registered corpus queries against their SQL."""

import os

import pytest

from lingualoom.llm import catalog
from tests.compare import compare

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_its_sql(spark, name):
    status, _, _, note = compare(spark, name, catalog.QUERIES[name], catalog.ORACLE[name], DATA)
    assert status == "OK", note


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{k}" for k in range(1, 14)]
