"""Cluster profiles, names and per-cluster dashboard tables.

The profile has one row per cluster (k rows, a fit parameter), so the naming
rules may use windows over it; the per-customer work is plain grouped
aggregation with partial (map-side) combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnforge.functions import constants as K
from churnforge.functions import exprs as X
from churnforge.operators.stats import group_mode, with_params


def cluster_profile(df: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """count, mean Total/Monthly/tenure/probability, modal Contract and PaymentMethod."""
    prob = F.col("Churn_Probability") if "Churn_Probability" in df.columns else F.lit(0.0)
    base = df.groupBy(cluster_col).agg(
        F.count(F.lit(1)).alias("Customer_Count"),
        F.avg(F.coalesce(F.col("TotalCharges").cast("double"), F.lit(0.0))).alias("Avg_Spending"),
        F.avg(F.coalesce(F.col("MonthlyCharges").cast("double"), F.lit(0.0))).alias("Avg_Monthly_Charges"),
        F.avg("tenure").alias("Avg_Tenure"),
        F.avg(prob).alias("Churn_Risk"))
    out = base
    for col, alias in (("Contract", "Preferred_Contract"), ("PaymentMethod", "Preferred_Payment_Method")):
        if col in df.columns:
            mode = group_mode(df, [cluster_col], col, alias)
            out = out.join(F.broadcast(mode), cluster_col, "left")
        else:
            out = out.withColumn(alias, F.lit(None).cast("string"))
        out = out.withColumn(alias, F.coalesce(F.col(alias), F.lit("Unknown")))
    return out


def cluster_names(profile: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """High-Risk → Premium → Loyal/New → "Segment k+1", over the k-row profile.

    Ties are broken by the smaller cluster id.
    """
    c = F.col(cluster_col)
    w_all = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = profile.withColumn("_med_tenure", F.percentile(F.col("Avg_Tenure"), 0.5).over(w_all))
    risk_rank = F.row_number().over(Window.orderBy(F.col("Churn_Risk").desc(), c.asc()))
    p = p.withColumn("_r1", risk_rank)
    prem_rank = F.row_number().over(Window.partitionBy(F.col("_r1") == 1).orderBy(
        F.col("Avg_Spending").desc(), F.col("Avg_Monthly_Charges").desc(), c.asc()))
    p = p.withColumn("_r2", F.when(F.col("_r1") != 1, prem_rank))
    rest = (F.col("_r1") != 1) & (F.col("_r2") != 1)
    ten_rank = F.row_number().over(Window.partitionBy(rest).orderBy(F.col("Avg_Tenure").desc(), c.asc()))
    p = p.withColumn("_r3", F.when(rest, ten_rank))
    name = (F.when(F.col("_r1") == 1, K.CLUSTER_NAMES["risk"])
            .when(F.col("_r2") == 1, K.CLUSTER_NAMES["premium"])
            .when((F.col("_r3") == 1) & (F.col("Avg_Tenure") >= F.col("_med_tenure")), K.CLUSTER_NAMES["loyal"])
            .when(F.col("_r3") == 1, K.CLUSTER_NAMES["new"])
            .otherwise(F.concat(F.lit(K.CLUSTER_NAMES["other"].split("{n}")[0]), (c + 1).cast("string"))))
    return p.withColumn("Cluster_Name", name).drop("_med_tenure", "_r1", "_r2", "_r3")


def cluster_sizes(df: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """Count and share (%, 2 dp) per cluster; the total is a one-row aggregate."""
    counts = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("Customers"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (with_params(counts, total)
            .withColumn("Share_Pct", F.round(F.col("Customers") * 100.0 / F.col("_total"), 2))
            .drop("_total"))


def cluster_means(df: DataFrame, currency: str = "SAR", rate: float = K.USD_TO_SAR,
                  cluster_col: str = "Cluster") -> DataFrame:
    return df.groupBy(cluster_col).agg(
        F.round(F.avg("tenure"), 2).alias("Avg_Tenure"),
        F.round(F.avg(X.convert_currency("MonthlyCharges", currency, rate)), 2).alias("Avg_MonthlyCharges"),
        F.round(F.avg(X.convert_currency(F.coalesce(F.col("TotalCharges").cast("double"), F.lit(0.0)),
                                         currency, rate)), 2).alias("Avg_TotalCharges"))


def cluster_shares(df: DataFrame, columns: list[str] | None = None, cluster_col: str = "Cluster") -> DataFrame:
    """Long form (Cluster, Feature, Value, Share_Pct): % of each category per cluster, 1 dp."""
    cols = [c for c in (columns or (K.SERVICE_COLUMNS + ["TechSupport", "InternetService", "Contract"]))
            if c in df.columns]
    stacked = df.select(cluster_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("Feature"), F.col(c).cast("string").alias("Value")) for c in cols])).alias("kv"))
    counts = stacked.groupBy(cluster_col, "kv.Feature", "kv.Value").agg(F.count(F.lit(1)).alias("n"))
    sizes = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_size"))
    return (counts.join(F.broadcast(sizes), cluster_col)
            .select(cluster_col, "Feature", "Value", F.round(F.col("n") * 100.0 / F.col("_size"), 1).alias("Share_Pct")))


def minmax_scaled(profile: DataFrame, cols: list[str]) -> DataFrame:
    """(x − min)/(max − min) per column over the k-row profile; zero range → divide by 1."""
    w = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = profile
    for c in cols:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
        out = out.withColumn(c, (F.col(c) - lo) / rng)
    return out


def cluster_heatmap(profile: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    cols = ["Customer_Count", "Avg_Spending", "Avg_Monthly_Charges", "Avg_Tenure", "Churn_Risk"]
    p = profile.select("Cluster_Name", F.col("Customer_Count").cast("double").alias("Customer_Count"),
                       X.convert_currency("Avg_Spending", currency, rate).alias("Avg_Spending"),
                       X.convert_currency("Avg_Monthly_Charges", currency, rate).alias("Avg_Monthly_Charges"),
                       "Avg_Tenure", "Churn_Risk")
    return minmax_scaled(p, cols)


def cluster_radar(profile: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    cols = ["Avg_Spending", "Avg_Monthly_Charges", "Avg_Tenure", "Churn_Risk"]
    labels = ["Avg Spending", "Monthly Charges", "Tenure", "Churn Risk"]
    p = profile.select("Cluster_Name",
                       X.convert_currency("Avg_Spending", currency, rate).alias("Avg_Spending"),
                       X.convert_currency("Avg_Monthly_Charges", currency, rate).alias("Avg_Monthly_Charges"),
                       "Avg_Tenure", "Churn_Risk")
    scaled = minmax_scaled(p, cols)
    return scaled.select("Cluster_Name", F.inline(F.array(*[
        F.struct(F.lit(lbl).alias("Axis"), F.col(c).alias("Value")) for c, lbl in zip(cols, labels)])))
