"""Passes over wide tables of many rows: distinct rows, columns with many values, counted quantiles, correlations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnforge.operators import clean as C
from churnforge.operators import quality as Q
from churnforge.operators.stats import exact_quantiles


def odd_rows(spark):
    nan = float("nan")
    rows = [(1, 0.0, "a"), (1, -0.0, "a"), (None, 1.0, None), (None, 1.0, None), (1, None, None), (2, nan, "b"), (2, nan, "b"), (3, nan, "b"), (4, 2.0, "c")]
    return spark.createDataFrame(rows * 3 + [(9, 9.0, "z"), (None, None, "1"), (1, None, None)], "i int, x double, t string").repartition(3)


def test_distinct_rows_as_drop_duplicates(spark):
    df = odd_rows(spark)
    assert C.distinct_rows(df) == df.dropDuplicates().count()
    plain = spark.range(500).select("id", F.col("id").cast("string").alias("t"))
    assert C.distinct_rows(plain) == 500
    assert C.distinct_rows(plain.where("id < 0")) == 0


def test_rows_of_one_hash_are_compared(spark, monkeypatch):
    monkeypatch.setattr(C.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    df = odd_rows(spark)
    assert C.distinct_rows(df) == df.dropDuplicates().count()


def test_more_distinct_sees_values_of_late_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "FIRST_ROWS", 5)
    df = spark.range(0, 400, 1, 4).select(
        F.col("id").alias("many"), (F.col("id") % 3).alias("few"), F.when(F.col("id") > 380, F.col("id")).otherwise(0).alias("late"),
        F.lit(None).cast("double").alias("none"), (F.col("id") % 11).cast("double").alias("eleven"), (F.col("id") % 10).alias("ten"))
    want = {c for c, n in C.distinct_counts(df, df.columns).items() if n > 10}
    assert C.more_distinct(df, df.columns, 10) == want == {"many", "late", "eleven"}


def test_columns_of_many_values_are_not_spelled_out(spark, monkeypatch):
    asked, whole = [], C.distinct_counts
    monkeypatch.setattr(C, "distinct_counts", lambda df, cols: asked.append((df, list(cols))) or whole(df, cols))
    df = spark.range(5000).select("id", (F.col("id") * 0.5).alias("half"), (F.col("id") % 4).alias("four"))
    assert C.iqr_bounds(df, ()).keys() == {"id", "half"}
    assert [c for d, c in asked if d.limit(5001).count() > C.FIRST_ROWS] == [["four"]]


@pytest.mark.parametrize("n", [37, 30_000])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    t = np.column_stack([rng.normal(size=n) * 1e8, rng.integers(0, 9, n), np.exp(rng.normal(size=n) * 40), np.full(n, 3.5)])
    t[rng.random(t.shape) < 0.2] = np.nan
    t[0, 0], t[1, 0] = np.inf, -np.inf
    df = spark.createDataFrame([tuple(None if k % 2 and np.isnan(v) else float(v) for k, v in enumerate(r)) for r in t], "a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r["column"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["a", "b", "c", "d"], probs).collect()}
    big = np.finfo(float).max
    for k, c in enumerate("abcd"):
        v = np.clip(t[:, k], -big, big)
        v = np.sort(v[~np.isnan(v)])
        for p in probs:
            h = (len(v) - 1) * p
            a, b = v[int(np.floor(h))], v[int(np.ceil(h))]
            assert got[c, p] == pytest.approx(a + (b - a) * (h - np.floor(h)), rel=1e-12), (c, p)


def test_quantiles_of_the_smallest_numbers(spark):
    least = 5e-324
    df = spark.range(6000).select(F.when(F.col("id") < 4000, 0.0).otherwise(F.lit(least)).alias("x"))
    assert {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["x"], [0.5, 0.75]).collect()} == {0.5: 0.0, 0.75: least}


def test_eight_columns_take_the_gram_pass(spark, monkeypatch):
    asked, gram = [], Q.correlations
    monkeypatch.setattr(Q, "correlations", lambda df, cols: asked.append(list(cols)) or gram(df, cols))
    rng = np.random.default_rng(1)
    t = rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8))
    df = spark.createDataFrame([tuple(map(float, r)) for r in t], ", ".join(f"c{k} double" for k in range(8)))
    got = {(r["a"], r["b"]): r["r"] for r in Q.correlation_frame(df, df.columns).collect()}
    assert asked == [df.columns]
    assert all(abs(got[f"c{i}", f"c{j}"] - np.corrcoef(t[:, i], t[:, j])[0, 1]) < 1e-9 for j in range(8) for i in range(j))
