"""Properties of the results."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventclime.functions.classify import classify
from eventclime.functions.parse import parse_int, parse_yyyymmdd
from eventclime.operators import windows
from eventclime.plans.batch_queries import _fx

from conftest import SF_ORACLE


def test_attention_shares_sum_to_at_most_100(spark):
    res = windows.attention_share(_fx(spark, SF_ORACLE)["events"])
    sums = res.groupBy("window_start").agg(F.sum("pct").alias("s")).collect()
    assert sums and all(r.s <= 100 + 1e-9 for r in sums)
    assert all(0 < r.pct <= 100 for r in res.collect())


def test_instability_within_bounds(spark):
    res = windows.instability_index(_fx(spark, SF_ORACLE)["events"]).collect()
    assert res and all(0 < r.pct <= 100 for r in res)


def _py_classify(t, rules):
    if t is None or math.isnan(t):
        return None
    for name, bound in rules:
        if t < bound:
            return name
    return None


@settings(max_examples=15, deadline=None)
@given(
    temps=st.lists(st.one_of(st.none(), st.floats(allow_infinity=True, allow_nan=True, width=64)), min_size=1, max_size=40),
    bounds=st.lists(st.integers(-50, 60), min_size=1, max_size=4, unique=True),
)
def test_classes_partition_temperatures(spark, temps, bounds):
    rules = [(f"c{i}", b) for i, b in enumerate(sorted(bounds))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(temps)], "i int, t double")
    got = {r.i: r.c for r in df.select("i", classify(F.col("t"), rules).alias("c")).collect()}
    assert got == {i: _py_classify(t, rules) for i, t in enumerate(temps)}


@settings(max_examples=10, deadline=None)
@given(tokens=st.lists(st.one_of(
    st.integers(-2**40, 2**40).map(str),
    st.sampled_from(["", " 5", "5 ", "5.0", "+7", "-0", "x", "1e3", "2147483648", "-2147483648"]),
), min_size=1, max_size=30))
def test_int_tokens_follow_integer_parse_rules(spark, tokens):
    def py(tok):
        if not tok or tok.strip() != tok:
            return None
        try:
            v = int(tok)
        except ValueError:
            return None
        if "_" in tok or not (-2**31 <= v < 2**31):
            return None
        return v

    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", parse_int(F.col("t")).alias("v")).collect()}
    assert got == {i: py(t) for i, t in enumerate(tokens)}


def test_strict_dates(spark):
    df = spark.createDataFrame([("20170201",), ("20171332",), ("20170201xx",), ("",), ("2017021",), ("20160229",), ("20170229",)], "t string")
    got = [r.d for r in df.select(parse_yyyymmdd(F.col("t")).alias("d")).collect()]
    assert [str(d) if d else None for d in got] == ["2017-02-01", None, None, None, None, "2016-02-29", None]
