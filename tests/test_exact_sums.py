"""Sums that do not depend on the order of addition."""

import math
import random
from fractions import Fraction

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from churnforge.operators import profile as P
from churnforge.operators.stats import exact_sums


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False).filter(lambda x: x == 0 or abs(x) > 1e-3), min_size=1, max_size=60), st.randoms())
def test_same_bits_in_any_order(spark, values, rng):
    other = list(values)
    rng.shuffle(other)
    seen = set()
    for rows, parts in ((values, 1), (other, 3), (sorted(values), 7)):
        df = spark.createDataFrame([(v,) for v in rows], "x double").repartition(parts)
        seen.add(exact_sums(df, {"x": F.col("x")}, {"x": max(map(abs, rows))})["x"])
    assert len(seen) == 1
    want = sum(map(Fraction, values))
    assert math.isclose(seen.pop(), float(want), rel_tol=4e-16, abs_tol=1e-16)


def test_sums_that_plain_addition_loses(spark):
    rng = random.Random(1)
    values = [1e16, 1.0, -1e16, 0.1] * 500 + [rng.uniform(-1, 1) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(4)
    got = exact_sums(df, {"x": F.col("x"), "none": F.col("x") * 0}, {"x": 1e16, "none": 0.0})
    assert got["none"] == 0.0 and math.isclose(got["x"], math.fsum(values), rel_tol=1e-13)


def test_describe_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    runs = {tuple(map(tuple, P.describe_all(d).select("column", "mean", "std").collect())) for d in (df.coalesce(1), df.repartition(9))}
    assert len(runs) == 1
    pandas = df.toPandas().describe()
    for c, mean, std in runs.pop():
        assert math.isclose(mean, pandas[c]["mean"], rel_tol=1e-12) and math.isclose(std, pandas[c]["std"], rel_tol=1e-10)
