"""Semantics on hand-made micro-frames (blank text, numeric text, ties, nulls, edges)."""

import math

import numpy as np
from pyspark.sql import functions as F

from churnforge.functions import exprs as X
from churnforge.operators import clean as C
from churnforge.operators import dashboard as D
from churnforge.operators import evaluate as E
from churnforge.operators import quality as Q
from churnforge.operators import stats as S
from churnforge.operators import business as B


def test_blank_to_null(spark):
    df = spark.createDataFrame([("",), (" ",), ("\t",), ("x",), (None,)], "s string")
    out = [r.s for r in C.blank_to_null(df).collect()]
    assert out == [None, None, None, "x", None]


def test_numeric_text_parse(spark):
    vals = ['1d', '1f', ' 2 ', '1e3', 'inf', 'nan', '0x10', '1,000', 'True', '+5', '.5', '5.']
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.v for r in df.select(X.parse_number("s").alias("v")).collect()]
    want = [None, None, 2.0, 1000.0, math.inf, None, None, None, None, 5.0, 0.5, 5.0]
    assert got == want


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert C.modes(df, ["c"]) == {"c": "a"}
    filled = C.impute_mode(df, exempt=())
    assert sorted(r.c for r in filled.collect()) == ["a", "a", "a", "b", "b"]


def test_dedup_null_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1)], "a string, b int")
    assert C.dedup_exact(df).count() == 1


def test_constant_columns_count_null(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, None)], "a int, b int, c string")
    assert C.constant_columns(df) == ["a", "c"]
    df2 = spark.createDataFrame([(1,), (None,)], "a int")
    assert C.constant_columns(df2) == []


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert Q.pairwise_correlations(df, ["a", "b"]) == [("a", "b", None)]


def test_tenure_buckets_right_closed(spark):
    df = spark.createDataFrame([(t, 10.0) for t in (-1, 0, 6, 7, 72, 73)], "tenure int, MonthlyCharges double")
    rows = {r.Tenure_Bucket: r.MonthlyRevenue for r in D.revenue_by_tenure(df).collect()}
    assert rows["0-6"] == 20.0 and rows["7-12"] == 10.0 and rows["61-72"] == 10.0
    assert sum(rows.values()) == 40.0 and len(rows) == 7


def test_iqr_zero_skipped(spark):
    vals = [5.0] * 20 + [float(i) for i in range(12)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out, changed = C.clip_iqr(df, exempt=())
    assert changed == []


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=501) * 10, 1)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r.prob: r.quantile for r in S.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    for p, v in got.items():
        assert abs(v - np.quantile(vals, p)) < 1e-9


def test_auc_with_ties_matches_pair_count(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "Churn int, Churn_Probability double")
    got = E.roc_auc(df).first().ROC_AUC
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


def test_one_class_no_imbalance_issue(spark):
    df = spark.createDataFrame([("a", "No"), ("b", "No")], "customerID string, Churn string")
    assert Q.minority_share(df, "Churn") is None


def test_risk_edges(spark):
    df = spark.createDataFrame([(0.39999,), (0.4,), (0.6,), (0.8,), (1.0,), (None,), (float("nan"),)], "p double")
    got = [r.t for r in df.select(X.risk_level("p").alias("t")).collect()]
    assert got == ["Low", "Medium", "High", "Critical", "Critical", "Low", "Low"]


def test_offer_threshold(spark):
    df = spark.createDataFrame([("Critical", 299.0), ("Critical", 300.0), ("High", 1.0), ("Low", 1.0)],
                               "Risk_Level string, MonthlyCharges double")
    got = [r.Retention_Offer for r in B.retention_offer(df).collect()]
    assert got[0].startswith("No offer") and got[1].startswith("25%") and got[2].startswith("15%")


def test_running_sum_many_slices(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    out = S.running_sum(df, "k", ["v"], slices=13).orderBy("k").collect()
    want = np.cumsum([i % 7 for i in range(1000)])
    assert [r.cum_v for r in out] == list(want)


def test_hot_value_third_of_rows(spark):
    """One value holding a third of the rows: modes, quantiles, dedup and AUC stay exact."""
    rng = np.random.default_rng(5)
    n = 3000
    vals = np.where(np.arange(n) < n // 3, 7.0, np.round(rng.normal(size=n) * 5, 2))
    text = np.where(np.arange(n) < n // 3, "hot", [f"v{i % 50}" for i in range(n)])
    df = spark.createDataFrame([(float(v), str(t), int(i % 2)) for i, (v, t) in enumerate(zip(vals, text))],
                               "x double, t string, y int")
    assert C.modes(df, ["t"]) == {"t": "hot"}
    q = {r.prob: r.quantile for r in S.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]).collect()}
    for p, v in q.items():
        assert abs(v - np.quantile(vals, p)) < 1e-9
    dup = spark.createDataFrame([(1, "a")] * 1000 + [(2, "b")], "k int, v string")
    assert C.dedup_exact(dup).count() == 2
    got = E.roc_auc(df.withColumnRenamed("y", "Churn").withColumnRenamed("x", "Churn_Probability")).first().ROC_AUC
    y = np.array([i % 2 for i in range(n)])
    pos, neg = vals[y == 1], vals[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12
