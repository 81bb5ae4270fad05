"""Chart input tables (the drawing itself is not part of the engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions import constants as K
from churnforge.functions import exprs as X
from churnforge.operators.stats import with_params


def _revenue(c) -> F.Column:
    return F.coalesce(F.sum(X.dec_money(c)), F.lit(0).cast("decimal(28,2)")).cast("double")


def revenue_by_segment(df: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    return (df.groupBy("Cluster_Name").agg(_revenue("MonthlyCharges").alias("_usd"))
            .select("Cluster_Name", X.convert_currency("_usd", currency, rate).alias("Revenue"))
            .orderBy(F.col("Revenue").desc()))


def clv_by_segment(df: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    return (df.groupBy("Cluster_Name")
            .agg(F.avg(X.convert_currency("TotalCharges", currency, rate)).alias("CLV"))
            .orderBy(F.col("CLV").desc()))


def equal_width_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts per equal-width bin over [min, max]; the max value falls in the last bin.

    min/max are a one-row aggregate broadcast to the rows; only non-empty bins
    are emitted.
    """
    x = F.col(col).cast("double")
    clean = df.select(X.nan_to_null(x).alias("_x")).filter(F.col("_x").isNotNull())
    rng = clean.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) * bins / width), F.lit(bins - 1)))
    binned = with_params(clean, rng).withColumn("Bin", idx.cast("int"))
    return binned.groupBy("Bin").agg(
        F.count(F.lit(1)).alias("Count"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")).select(
        "Bin",
        (F.col("_lo") + F.col("Bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("Bin_Start"),
        (F.col("_lo") + (F.col("Bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("Bin_End"),
        "Count")


def revenue_histogram(df: DataFrame, bins: int = 36, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    conv = df.select(X.convert_currency("MonthlyCharges", currency, rate).alias("Monthly"))
    return equal_width_histogram(conv, "Monthly", bins)


def revenue_by_tenure(df: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    """Right-closed tenure buckets; empty buckets give 0, tenures outside are dropped."""
    spark = df.sparkSession
    bucket = None
    for i, (lo, hi, label) in enumerate(K.TENURE_BUCKETS):
        cond = (F.col("tenure") > lo) & (F.col("tenure") <= hi)
        bucket = F.when(cond, i) if bucket is None else bucket.when(cond, i)
    sums = (df.select(bucket.alias("Bucket_Order"), "MonthlyCharges")
            .filter(F.col("Bucket_Order").isNotNull())
            .groupBy("Bucket_Order").agg(_revenue("MonthlyCharges").alias("_usd")))
    grid = spark.createDataFrame([(i, label) for i, (_, _, label) in enumerate(K.TENURE_BUCKETS)],
                                 "Bucket_Order int, Tenure_Bucket string")
    # sums has at most 7 rows; AQE broadcasts it at runtime.
    return (grid.join(sums, "Bucket_Order", "left")
            .select("Bucket_Order", "Tenure_Bucket",
                    X.convert_currency(F.coalesce(F.col("_usd"), F.lit(0.0)), currency, rate).alias("MonthlyRevenue"))
            .orderBy("Bucket_Order"))
