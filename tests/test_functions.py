"""Numeric and string functions against NumPy, pandas and Python."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspan.functions import numeric as N
from larkspan.functions import strings as S

ODD = [0.0, -0.0, 1.0, -1.0, 0.5, -8.0, 1000.0, float("nan"), float("inf"), float("-inf"), 1e-300, None]


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-9 * max(1, abs(b))


def column(spark, values, expr, parts=1):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double").repartition(parts)
    return [r[0] for r in df.select("id", expr(F.col("x")).alias("y")).orderBy("id").select("y").collect()]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_divide_as_ieee(spark, parts):
    pairs = [(a, b) for a in ODD for b in ODD]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a double, b double").repartition(parts)
    got = [r[0] for r in df.select("id", N.divide("a", "b").alias("q")).orderBy("id").select("q").collect()]
    with np.errstate(all="ignore"):
        want = [None if a is None or b is None else float(np.float64(a) / np.float64(b)) for a, b in pairs]
    assert all(map(same, got, want))


@pytest.mark.parametrize("name,f", [("log", np.log), ("log2", np.log2), ("log1p", np.log1p), ("exp", np.exp), ("sin", np.sin), ("cos", np.cos), ("arcsin", np.arcsin), ("sqrt", np.sqrt), ("absolute", np.abs)])
def test_unary_as_numpy(spark, name, f):
    with np.errstate(all="ignore"):
        want = [None if v is None else float(f(np.float64(v))) for v in ODD]
    assert all(map(same, column(spark, ODD, getattr(N, name)), want))


def test_power(spark):
    with np.errstate(all="ignore"):
        want = [None if v is None else float(np.power(np.float64(v), -1.0)) for v in ODD if v != 0 or v is None]
    assert all(map(same, column(spark, [v for v in ODD if v != 0 or v is None], lambda x: N.power(x, -1.0)), want))


@pytest.mark.parametrize("name,op", [("greater", np.greater), ("greater_equal", np.greater_equal), ("less", np.less), ("equal", np.equal)])
def test_comparisons_know_nan(spark, name, op):
    got = column(spark, ODD, lambda x: getattr(N, name)(x, 0.5))
    assert got == [None if v is None else bool(op(v, 0.5)) for v in ODD]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-6, 6), min_size=1, max_size=30))
def test_erf(spark, xs):
    want = [math.erf(x) for x in xs]
    assert all(abs(a - b) < 1e-12 for a, b in zip(column(spark, xs, N.erf), want))
    assert all(abs(a - b) < 1.5e-7 for a, b in zip(column(spark, xs, lambda x: N.erf(x, "fast")), want))


def test_mask_and_modulus(spark):
    assert column(spark, [1.0, 5.0, None], lambda x: N.mask(x, N.greater(x, 2.0), 0.0)) == [1.0, 0.0, None]
    assert column(spark, [-3.0, 3.0], lambda x: N.modulus(x.cast("int"), 5)) == [2, 3]


def test_rounded_as_duckdb(spark):
    values = [*ODD, 0.5e-6, -1.5e-6, 1.0000005, 2.5000015, 123456789.1234565, 1e300, -1e305, 4503599627.3704965]
    want = [None if v is None else duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    got = column(spark, values, lambda x: N.rounded(x, 6))
    assert [repr(None if v is None else v + 0.0) for v in got] == [repr(None if v is None else v + 0.0) for v in want]


TEXTS = ["The", "the", "THE", "A b", "Hello, World", "", None, "a.c", "abc", "Éa", "x1Y"]


def test_strings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string")
    t = F.col("t")
    rows = df.select("id", S.slice_text(t, 1, 3).alias("cut"), S.contains(t, "a.c").alias("hit"), S.is_title(t).alias("title"), S.lower(t).alias("low"), S.same(t, "the").alias("eq")).orderBy("id").collect()
    s = pd.Series(TEXTS)
    for r, x in zip(rows, TEXTS):
        if x is None:
            assert r.cut is None and r.hit is None and r.title is None
        else:
            assert r.cut == x[1:3] and r.title == x.istitle() and r.low == x.lower() and r.eq == (x == "the")
    assert [r.hit for r in rows] == [None if v is None or v != v else bool(v) for v in s.str.contains("a.c")]


def test_sentences(spark):
    df = spark.createDataFrame([("Go. Stop! wait ... Now",), ("",), (". A b",)], "t string")
    words = df.select(S.tokens(F.col("t")).alias("w"))
    got = words.select("w", S.sentence_begins(F.col("w")).alias("b")).collect()
    assert got[0].w == ["Go", ".", "Stop", "!", "wait", "...", "Now"] and got[0].b == [True, False, True, False, True, False, True]
    assert got[1].w == [] and got[2].b == [True, False, False]
