"""Every query of the catalogue against DuckDB, and the results that SQL cannot give."""

import math

import pytest

from larkspan.plans import catalogue
from oracle import assert_same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, SMALL), SMALL, catalogue.SQL[name])


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries()) and set(catalogue.SQL) <= set(e.oracle_sql())


def test_exact_erf_is_near_the_fast_one(spark):
    got = sorted(r.e for r in catalogue.QUERIES["erf_exact"](spark, SMALL).collect())
    want = sorted(math.erf((r.l_quantity - 25) / 20) for r in catalogue.read(spark, SMALL, "lineitem").collect())
    assert len(got) == len(want) and all(abs(a - b) < 1e-6 for a, b in zip(got, want))
