"""Model evaluation: confusion, accuracy/precision/recall/F1, exact ROC AUC with
ties, ROC and precision-recall curves, actual-vs-predicted table.

Curves and AUC collapse predictions to distinct scores first (partial
aggregate), then use the distributed ``running_sum`` for cumulative true and
false positives; neighbouring thresholds are paired by an equi-join on the
threshold rank, never by a global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.operators.stats import running_sum, with_params


def confusion(df: DataFrame, label: str = "Churn", pred: str = "Predicted_Churn") -> DataFrame:
    """2×2 counts; both classes always present (right join to the 4-cell grid)."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)], "Actual int, Predicted int")
    counts = df.groupBy(F.col(label).cast("int").alias("Actual"), F.col(pred).cast("int").alias("Predicted")) \
        .agg(F.count(F.lit(1)).alias("Customers"))
    return (grid.join(counts, ["Actual", "Predicted"], "left")
            .select("Actual", "Predicted", F.coalesce("Customers", F.lit(0)).alias("Customers")))


def classification_metrics(df: DataFrame, label: str = "Churn", pred: str = "Predicted_Churn",
                           group: list[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division → 0), optionally per group (e.g. model)."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    tp = F.count_if((y == 1) & (p == 1))
    fp = F.count_if((y == 0) & (p == 1))
    fn = F.count_if((y == 1) & (p == 0))
    base = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.count_if(y == p).alias("_ok"),
                                  tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"))
    prec = F.coalesce(F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")), F.lit(0.0))
    return base.select(*group, (F.col("_ok") / F.col("_n")).alias("Accuracy"), prec.alias("Precision"),
                       rec.alias("Recall"), f1.alias("F1_Score"))


def _ranked_scores(df: DataFrame, label: str, score: str, group: list[str]) -> DataFrame:
    y = F.col(label).cast("int")
    counts = df.groupBy(*group, F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"), F.lit(1).alias("one"))
    return running_sum(counts, "score", ["pos", "neg", "one"], group_cols=list(group), descending=True)


def roc_auc(df: DataFrame, label: str = "Churn", score: str = "Churn_Probability", group: list[str] = ()) -> DataFrame:
    """Exact AUC = P(score⁺ > score⁻) + ½ P(tie), by group."""
    r = _ranked_scores(df, label, score, list(group))
    part = r.groupBy(*group).agg(
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)).alias("_area"),
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return part.select(*group, F.try_divide(F.col("_area"), F.col("_P") * F.col("_N")).alias("ROC_AUC"))


def roc_curve(df: DataFrame, label: str = "Churn", score: str = "Churn_Probability", group: list[str] = (),
              drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) with the (0, 0) start at threshold +inf; collinear points dropped."""
    group = list(group)
    r = _ranked_scores(df, label, score, group)
    nxt = r.select(*group, (F.col("cum_one") - 1).alias("cum_one"), F.col("pos").alias("_np"),
                   F.col("neg").alias("_nn"))
    j = r.join(nxt, [*group, "cum_one"], "left")
    totals = r.groupBy(*group).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    keep = (F.col("cum_one") == 1) | F.col("_np").isNull() | (F.col("_np") != F.col("pos")) | (F.col("_nn") != F.col("neg"))
    pts = j.filter(keep) if drop_intermediate else j
    pts = pts.join(F.broadcast(totals), group, "inner") if group else with_params(pts, totals)
    curve = pts.select(*group, F.col("cum_one").alias("point"), F.col("score").cast("double").alias("threshold"),
                       F.try_divide(F.col("cum_neg"), F.col("_N")).alias("fpr"),
                       F.try_divide(F.col("cum_pos"), F.col("_P")).alias("tpr"))
    start = (totals.select(*group, F.lit(0).cast("bigint").alias("point"),
                           F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    return curve.unionByName(start)


def pr_curve(df: DataFrame, label: str = "Churn", score: str = "Churn_Probability", group: list[str] = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the end point (precision 1, recall 0)."""
    group = list(group)
    r = _ranked_scores(df, label, score, group)
    totals = r.groupBy(*group).agg(F.sum("pos").alias("_P"))
    pts = r.join(F.broadcast(totals), group, "inner") if group else with_params(r, totals)
    ps = F.col("cum_pos") + F.col("cum_neg")
    curve = pts.select(*group, F.col("score").cast("double").alias("threshold"),
                       F.when(ps != 0, F.col("cum_pos") / ps).otherwise(F.lit(0.0)).alias("precision"),
                       F.when(F.col("_P") == 0, F.lit(1.0)).otherwise(F.col("cum_pos") / F.col("_P")).alias("recall"))
    end = totals.select(*group, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                        F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


def actual_vs_predicted(df: DataFrame, label: str = "Churn", pred: str = "Predicted_Churn") -> DataFrame:
    """Crosstab of actual × predicted melted to (Actual, Predicted, Customers).

    Cells are every observed actual value × every observed predicted value
    (zeros included); both value sets have class-count size.
    """
    cells = df.groupBy(F.col(label).cast("int").alias("Actual"), F.col(pred).cast("int").alias("Predicted")) \
        .agg(F.count(F.lit(1)).alias("Customers"))
    acts = cells.select("Actual").distinct()
    # the observed predicted classes (class-count size) as one array, expanded per actual class
    preds = cells.agg(F.array_sort(F.collect_set("Predicted")).alias("_p")).select("_p").scalar()
    grid = acts.select("Actual", F.explode(preds).alias("Predicted"))
    return (grid.join(cells, ["Actual", "Predicted"], "left")
            .select("Actual", "Predicted", F.coalesce("Customers", F.lit(0)).cast("bigint").alias("Customers")))
