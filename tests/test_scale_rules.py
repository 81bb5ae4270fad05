"""Nothing is capped, estimated or lost: exact counts at any size, all columns, all rows, faithful files."""

import csv
import datetime as dt
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from churnforge.functions import constants as K
from churnforge.operators import business as B
from churnforge.operators import clean as C
from churnforge.operators import features as FE
from churnforge.operators import models as M
from churnforge.operators import profile as P
from churnforge.operators import quality as Q
from churnforge.operators import stats as S
from churnforge.plans.analytics import run_full_analytics
from churnforge.session import scratch_path
from churnforge.sources import files as IO
from churnforge.sources import fixtures


@pytest.mark.parametrize("distinct", [20_000, 50_000])
def test_distinct_counts_are_exact(spark, distinct):
    df = spark.range(3 * distinct).select(F.concat(F.lit("v"), F.col("id") % distinct).alias("a"), (F.col("id") % 7).alias("b"))
    assert C.distinct_counts(df, ["a", "b"]) == {"a": distinct, "b": 7}
    assert C.encoded_feature_count(df, ()) == distinct + 1


@pytest.mark.parametrize("share, fires", [(0.44, False), (0.46, True)])
def test_high_cardinality_line(spark, share, fires):
    n = 20_000
    df = spark.range(n).select(F.concat(F.lit("v"), F.col("id") % int(share * n)).alias("a"))
    assert any(i["Issue"].startswith("High-cardinality") for i in Q.detect_quality(df)[0]) == fires


def test_issue_rows_name_every_column(spark):
    df = spark.range(300).select(*[F.lit(1).alias(f"k{i}") for i in range(9)], *[(F.col("id") * (i + 1)).alias(f"r{i}") for i in range(4)])
    found = {i["Issue"]: i["Columns"] for i in Q.detect_quality(df)[0]}
    assert found["Constant columns"] == [f"k{i}" for i in range(9)]
    assert len(found["Highly correlated features"]) == 6


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    cols = {"tail": np.exp(rng.normal(0, 6, 20_000)), "ints": rng.integers(-5, 6, 20_000).astype(float), "wide": rng.normal(0, 1e307, 20_000),
            "one": np.full(20_000, 3.5), "gaps": np.where(rng.random(20_000) < 0.3, np.nan, rng.random(20_000))}
    rows = list(zip(*(c.tolist() for c in cols.values())))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    df = df.withColumn("gaps", F.when(~F.isnan("gaps"), F.col("gaps"))).withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["prob"]): r["quantile"] for r in S.exact_quantiles(df, [*cols, "none"], probs).collect()}
    assert len(got) == len(cols) * len(probs)
    for c, v in cols.items():
        for p in probs:
            assert np.isclose(got[c, p], np.nanquantile(v, p), rtol=1e-12)


def test_describe_has_every_column(spark):
    rows = [(1, "b", dt.date(2024, 1, 2), True, dt.datetime(2024, 1, 1)), (2, "a", dt.date(2023, 5, 1), True, None), (3, None, dt.date(2023, 5, 1), False, None)]
    got = {r["column"]: r for r in P.describe_all(spark.createDataFrame(rows, "n int, t string, d date, f boolean, ts timestamp")).collect()}
    assert set(got) == {"n", "t", "d", "f", "ts"} and got["n"]["mean"] == 2
    assert (got["d"]["unique"], got["d"]["top"], got["d"]["freq"], got["d"]["least"], got["d"]["greatest"]) == (2, "2023-05-01", 2, "2023-05-01", "2024-01-02")
    assert got["f"]["top"] == "true" and got["ts"]["count"] == 1


def test_missing_patterns_hold_all_rows(spark):
    df = fixtures.subscribers_raw(spark, SF_SMALL)
    rows = P.missing_patterns(df).collect()
    assert sum(r["Rows"] for r in rows) == df.count() > 500
    assert sum(r["Rows"] for r in rows if r["Partner"]) == C.blank_to_null(df).filter("Partner IS NULL").count()


def test_all_numeric_columns_are_drawn(spark):
    df = spark.range(100).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(9)])
    assert {r["column"] for r in P.histograms(df).collect()} == {r["column"] for r in P.box_stats(df).collect()} == {f"c{i}" for i in range(9)}


def test_csv_round_trip(spark):
    rows = [('say ""hi"" x', "one\ntwo", "1234567890123456789012345", "9223372036854775807"), ('"', 'a,b\r\nc', "5", "1"), ("\\", ' lead', "-1", "-3"), ("NA", "x'y", None, "12")]
    df = spark.createDataFrame(rows, "a string, b string, wide string, big string").coalesce(1)
    path = scratch_path(spark, "quotes") + ".csv"
    IO.sink_csv(df, path)
    back = IO.read_dataset(spark, path, line_breaks=True)
    assert dict(back.dtypes) == {"a": "string", "b": "string", "wide": "decimal(38,0)", "big": "bigint"}
    want = [(None if r[0] == "NA" else r[0], r[1], int(r[2]) if r[2] else None, int(r[3])) for r in rows]
    assert sorted((r.a or "", r.b, str(r.wide), r.big) for r in back.collect()) == sorted((w[0] or "", w[1], str(w[2]), w[3]) for w in want)
    with open(glob.glob(path.removeprefix("file://") + "/part-*")[0], newline="") as f:
        assert sorted(r[:2] for r in list(csv.reader(f))[1:]) == sorted([r[0], r[1]] for r in rows)


def test_integers_of_any_length_survive(spark):
    df = spark.createDataFrame([("9" * 25, "9" * 45, "7"), ("1", "2", "8")], "a string, b string, c string")
    got = IO.infer_types(df)
    assert dict(got.dtypes) == {"a": "decimal(38,0)", "b": "string", "c": "int"}
    assert got.filter("a IS NULL OR b IS NULL OR c IS NULL").count() == 0


def test_report_tables_do_not_overwrite_each_other(spark):
    one = spark.range(1)
    names = ["A very long name of a report table, first", "A very long name of a report table, second"]
    paths = IO.report_tables({n: one for n in names}, scratch_path(spark, "report"))
    assert len(set(paths.values())) == 2
    with pytest.raises(ValueError, match="share the folder"):
        IO.report_tables({"a b": one, "a_b": one}, scratch_path(spark, "report"))


def test_rows_without_a_key_are_in_one_part(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("customerID"), F.col("id").alias("x"))
    got = FE.split_80_20(df)
    assert got.filter("is_test IS NULL").count() == 0
    assert 0.1 < got.filter("customerID IS NULL").agg(F.avg("is_test")).first()[0] < 0.3


def test_required_and_unknown_columns(spark):
    with pytest.raises(ValueError, match="tenure"):
        C.require_columns(spark.range(1), ["id", "tenure"])
    subs = fixtures.subscribers(spark, SF_SMALL)
    more = subs.withColumn("Region", F.lit("north")).withColumn("LoadBatch", F.lit(7))
    assert FE.churn_features(more)[1].feature_columns == FE.churn_features(subs)[1].feature_columns
    assert FE.segment_features(more)[2] == FE.segment_features(subs)[2]
    assert "LoadBatch" in FE.churn_features(more, extra=("LoadBatch",))[1].feature_columns


def test_sparse_one_hot_has_no_limit(spark):
    df = spark.range(6000).select("id", F.concat(F.lit("c"), F.lpad((F.col("id") % 3000).cast("string"), 5, "0")).alias("code"), F.when(F.col("id") % 2 == 0, "x").alias("kind"))
    vocabulary = FE.category_table(df, ["code", "kind"])
    assert vocabulary.count() == 3001 and vocabulary.agg(F.max("index")).first()[0] == 3000
    got = {r.id: r.indices for r in FE.one_hot_sparse(df, vocabulary, "id", ["code", "kind"]).collect()}
    assert got[0] == [0, 3000] and got[1] == [1] and got[3001] == [1] and len(got) == 6000


def test_insights_without_optional_columns(spark):
    an = B.analysis_frame(fixtures.scored(spark, SF_SMALL)).drop("Contract", "Cluster_Name")
    said = [r.Executive_Insight for r in B.insights(an).orderBy("Insight_No").collect()]
    assert said[2].startswith("Month-to-month contracts") and said[3].startswith(K.INSIGHT_NO_SEGMENT["riskiest"])


def test_building_a_fixture_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    own = len(tracker.getJobIdsForGroup(None)) - before  # Spark reads one footer for a schema
    before = len(tracker.getJobIdsForGroup(None))
    fixtures.scored(spark, SF_SMALL)
    assert len(tracker.getJobIdsForGroup(None)) - before <= 2 * own


def test_trees_learn_a_known_rule(spark):
    df = fixtures.subscribers(spark, SF_SMALL).withColumn("Churn", F.when((F.col("tenure") < 20) & (F.col("MonthlyCharges") > 60), "Yes").otherwise("No"))
    data = M.prepare_training(df)
    specs = {s.name: s for s in M.model_specs(data.n_train)}
    for name in ("Decision Tree", "Gradient Boosting"):
        model, _ = M.fit_model(data, specs[name])
        wrong = M.predict(model, data.test).filter("Churn <> Predicted_Churn").count()
        assert wrong <= 0.02 * data.test.count(), name


def test_full_run_keeps_every_row(spark):
    subs = fixtures.subscribers(spark, SF_SMALL).limit(600)
    df = subs.withColumn("customerID", F.when(F.col("customerID").like("%7"), None).when(F.col("customerID").like("%3"), "shared").otherwise(F.col("customerID")))
    res = run_full_analytics(df, n_init=2)
    assert res.analysis.count() == 600
    assert {r.Model for r in res.model_metrics.collect()} == {s.name for s in M.model_specs(10)}
    ended = {r.Model: r.Convergence for r in res.model_metrics.collect()}
    assert "converged after" in ended["Logistic Regression"] and ended["Decision Tree"] is None
    assert res.curves.select("Model", "Curve").distinct().count() == 10
    assert res.confusion.count() > 0 and res.loadings.count() > 5 and res.segmentation_metrics.count() == 1 and res.learning_curve.count() == 5
