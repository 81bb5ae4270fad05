"""Telco-shaped subscriber tables derived from ``orders`` joined to ``customer``.

One order is one subscriber. Money is built from integer cents so the text and
double forms agree across engines. ``subscribers_raw`` adds the dirty inputs
the cleaner must handle; ``scored`` adds a fixed-coefficient churn score so the
operators after the model can be checked exactly.

The join is a plain equi-join on the customer key: Catalyst/AQE pick a
broadcast only when the customer side is under the size threshold, else a
sort-merge join with skew splitting. Building a fixture starts no job and keeps
nothing in executor storage; each query pays for its own scan and join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.sources.tables import read_table

def _case(*pairs, default):
    expr = None
    for cond, value in pairs:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    months = (2001 - F.year("o_orderdate")) * 12 + (7 - F.month("o_orderdate"))
    h = F.md5(F.col("o_orderkey").cast("string"))
    return joined.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("st"),
        F.col("o_orderpriority").alias("pr"),
        F.col("c_mktsegment").alias("seg"),
        F.col("c_nationkey").alias("nk"),
        (F.lit(1825) + F.floor("o_totalprice").cast("bigint") % 10051).cast("bigint").alias("cents"),
        F.greatest(F.least(months, F.lit(72)), F.lit(0)).cast("int").alias("tenure"),
        (F.ascii(F.substring(h, 1, 1)) + 3 * F.ascii(F.substring(h, 2, 1))
         + 7 * F.ascii(F.substring(h, 3, 1))).cast("bigint").__mod__(100).alias("u"),
    )


def _service(k: Column, seg: Column, modulus: int, below: int) -> Column:
    return _case((seg == "HOUSEHOLD", F.lit("No internet service")),
                 (k % modulus < below, F.lit("Yes")), default=F.lit("No"))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21-column subscriber table (one row per order)."""
    b = _base(spark, sf_dir)
    k, seg, st, tenure, cents = F.col("k"), F.col("seg"), F.col("st"), F.col("tenure"), F.col("cents")
    total_cents = cents * tenure
    total_text = F.concat(
        F.floor(total_cents.cast("double") / F.lit(100.0)).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((total_cents % 100).cast("string"), 2, "0"))
    churn_cut = (F.lit(8)
                 + _case((st == "F", F.lit(38)), (st == "O", F.lit(8)), default=F.lit(0))
                 + F.when(tenure <= 12, 22).otherwise(0)
                 + F.when(cents >= 7500, 10).otherwise(0)
                 - F.when(tenure > 48, 8).otherwise(0))
    return b.select(
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 9, "0")).alias("customerID"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(k % 6 == 0, 1).otherwise(0).cast("int").alias("SeniorCitizen"),
        F.when(F.col("nk") % 2 == 0, "Yes").otherwise("No").alias("Partner"),
        F.when(F.col("nk") % 10 < 3, "Yes").otherwise("No").alias("Dependents"),
        tenure.alias("tenure"),
        F.when(k % 10 == 0, "No").otherwise("Yes").alias("PhoneService"),
        _case((k % 10 == 0, F.lit("No phone service")), (k % 7 < 3, F.lit("Yes")),
              default=F.lit("No")).alias("MultipleLines"),
        _case((seg.isin("AUTOMOBILE", "MACHINERY"), F.lit("Fiber optic")), (seg == "HOUSEHOLD", F.lit("No")),
              default=F.lit("DSL")).alias("InternetService"),
        _service(k, seg, 3, 1).alias("OnlineSecurity"),
        _service(k, seg, 5, 2).alias("OnlineBackup"),
        _service(k, seg, 11, 4).alias("DeviceProtection"),
        _service(k, seg, 13, 4).alias("TechSupport"),
        _service(k, seg, 17, 7).alias("StreamingTV"),
        _service(k, seg, 19, 8).alias("StreamingMovies"),
        _case((st == "F", F.lit("Month-to-month")), (st == "O", F.lit("One year")),
              default=F.lit("Two year")).alias("Contract"),
        F.when(k % 5 < 3, "Yes").otherwise("No").alias("PaperlessBilling"),
        _case((F.substring("pr", 1, 1) == "1", F.lit("Electronic check")),
              (F.substring("pr", 1, 1) == "2", F.lit("Mailed check")),
              (F.substring("pr", 1, 1) == "3", F.lit("Bank transfer (automatic)")),
              (F.substring("pr", 1, 1) == "4", F.lit("Credit card (automatic)")),
              default=F.lit("Electronic check")).alias("PaymentMethod"),
        (cents.cast("double") / F.lit(100.0)).alias("MonthlyCharges"),
        F.when(tenure == 0, F.lit(" ")).otherwise(total_text).alias("TotalCharges"),
        F.when(F.col("u") < churn_cut, "Yes").otherwise("No").alias("Churn"),
    )


def subscribers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty variant: null Partner, constant Source, x10 outliers, exact duplicates."""
    f = subscribers(spark, sf_dir)
    r = f.select(
        "customerID", "gender", "SeniorCitizen",
        F.when((F.col("SeniorCitizen") == 1) & (F.col("tenure") % 10 == 3), F.lit(None).cast("string"))
        .otherwise(F.col("Partner")).alias("Partner"),
        "tenure", "Contract",
        F.when(F.col("tenure") == 71, F.col("MonthlyCharges") * 10).otherwise(F.col("MonthlyCharges"))
        .alias("MonthlyCharges"),
        "TotalCharges", F.lit("telco").alias("Source"), "Churn")
    return r.unionAll(r.filter(F.col("customerID").like("%77")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers plus a fixed-coefficient score, probability and cluster id."""
    f = subscribers(spark, sf_dir)
    z = (F.lit(0.9) - F.lit(0.024) * (F.col("tenure") - 38) + F.lit(0.010) * (F.col("MonthlyCharges") - 68)
         - _case((F.col("Contract") == "One year", F.lit(1.3)), (F.col("Contract") == "Two year", F.lit(2.0)),
                 default=F.lit(0.0))
         + F.lit(0.08) * F.col("SeniorCitizen"))
    return (f.withColumn("z", z)
            .withColumn("Churn_Probability", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z"))), 6))
            .withColumn("Cluster", _case((F.col("InternetService") == "No", F.lit(0)),
                                         (F.col("tenure") < 36, F.lit(1)), default=F.lit(2)))
            .withColumn("Predicted_Churn", F.when(F.col("Churn_Probability") > 0.5, 1).otherwise(0)))


MEASURES = ("quantity", "price", "discount", "tax", "net", "gross", "saved", "duty")


def line_measures(spark: SparkSession, sf_dir: str, flags: str = "RAN") -> DataFrame:
    """Eight measures of every order line, and each again for the lines of one return flag alone (null elsewhere)."""
    li = read_table(spark, sf_dir, "lineitem")
    price, discount, tax = (F.col(c).cast("double") for c in ("l_extendedprice", "l_discount", "l_tax"))
    net = price * (F.lit(1.0) - discount)
    values = dict(zip(MEASURES, (F.col("l_quantity").cast("double"), price, discount, tax, net, net * (F.lit(1.0) + tax), price * discount, net * tax)))
    only = [F.when(F.col("l_returnflag") == flag, v).alias(f"{name}_{flag}") for flag in flags for name, v in values.items()]
    return li.select(*[v.alias(name) for name, v in values.items()], *only)
