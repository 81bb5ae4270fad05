"""Plan checks: no Python UDF on the hot path, filters/projections reach the scan, no row-scale cartesian."""

from churnforge.operators import business as B
from churnforge.plans.frames import analysis
from churnforge.sources.tables import read_table
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_in_scored_table(spark):
    plan = _plan(analysis(spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_projection_and_filter_pushdown(spark):
    from pyspark.sql import functions as F
    df = read_table(spark, SF_SMALL, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_priority_uses_broadcast_of_one_row(spark):
    plan = _plan(B.priority_score(B.analysis_frame(read_table(spark, SF_SMALL, "orders")
                                                   .selectExpr("o_orderkey AS customerID", "1 AS Predicted_Churn",
                                                               "o_totalprice AS MonthlyCharges",
                                                               "CAST(o_custkey % 72 AS INT) AS tenure"))))
    assert "CartesianProduct" not in plan
    assert "Window" not in plan


# queries that attach one-row parameters, expand fixed grids/offsets or pair centroids
NO_PAIR_JOIN_KEYS = ["risk_summary", "cluster_sizes", "kde_by_class", "actual_vs_predicted", "balanced_weights",
                     "davies_bouldin", "calinski_harabasz", "insights", "box_stats", "histograms", "dbscan"]


def test_no_cartesian_or_nested_loop_join(spark):
    import __spark_entry__ as entry
    qs = entry.queries()
    for key in NO_PAIR_JOIN_KEYS:
        plan = _plan(qs[key](spark, SF_SMALL))
        assert "CartesianProduct" not in plan, key
        assert "BroadcastNestedLoopJoin" not in plan, key


def test_vocabulary_size_checked_before_collect(spark):
    import pytest
    from churnforge.operators import features as FE
    df = spark.range(FE.MAX_CATEGORIES + 1).selectExpr("CAST(id AS STRING) AS code", "'a' AS kind")
    with pytest.raises(ValueError, match="use one_hot_sparse"):
        FE.fit_vocabulary(df, ["code", "kind"])
    assert FE.fit_vocabulary(df.limit(3), ["kind"]) == {"kind": ["a"]}
