"""What is registered, and the SQL of the operators that SQL can express."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from pagemill.llm import queries
from tests.gate import compare, duck


def test_one_query_per_operator_and_the_pipeline():
    names = [n for n in E.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert "pipeline" in names and set(queries.ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_oracles(spark, sf, name):
    ok, msg = compare(spark, duck(sf), sf, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, msg
