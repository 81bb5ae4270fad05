"""Business scoring and KPI operators (risk tiers, offers, summaries, insights).

Input: an *analysis frame* — one row per customer with ``MonthlyCharges``,
``TotalCharges`` (numeric), ``tenure``, ``Churn`` (0/1), ``Predicted_Churn``,
``Churn_Probability``, ``Cluster`` and, once named, ``Cluster_Name``.
Global maxima come from one-row aggregates joined back by broadcast, never
from an unpartitioned window; money sums are DECIMAL so totals do not depend
on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions import constants as K
from churnforge.functions import exprs as X
from churnforge.operators.stats import group_mode, with_params


# ---------------------------------------------------------------------------------------
# analysis frame
# ---------------------------------------------------------------------------------------
def analysis_frame(df: DataFrame) -> DataFrame:
    """Blank→null, money columns numeric, TotalCharges null→0, Churn → 0/1."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in K.MONEY_COLUMNS:
            c = X.to_number(c, types[name])
            if name == "TotalCharges":
                c = F.coalesce(c, F.lit(0.0))
        elif name == "Churn":
            c = X.map_target(X.blank_to_null(c) if X.is_string(types[name]) else c, types[name])
        elif X.is_string(types[name]):
            c = X.blank_to_null(c)
        cols.append(c.alias(name))
    return df.select(*cols)


def risk_level(df: DataFrame, prob_col: str = "Churn_Probability", out: str = "Risk_Level") -> DataFrame:
    return df.withColumn(out, X.risk_level(prob_col))


def priority_score(df: DataFrame, floor_max_at_one: bool = True) -> DataFrame:
    """50·predicted + 30·monthly/max(monthly) + 20·(1 − tenure/max(tenure)).

    The two maxima are a one-row aggregate broadcast to every row.
    """
    mx = df.agg(F.max("MonthlyCharges").alias("_max_m"), F.max("tenure").alias("_max_t"))
    m, t = F.col("_max_m"), F.col("_max_t").cast("double")
    if floor_max_at_one:
        m, t = F.greatest(m, F.lit(1.0)), F.greatest(t, F.lit(1.0))
    out = with_params(df, mx).withColumn(
        "Priority_Score",
        F.col("Predicted_Churn") * 50 + (F.col("MonthlyCharges") / m) * 30 + (1 - F.col("tenure") / t) * 20)
    return out.drop("_max_m", "_max_t")


def retention_offer(df: DataFrame, threshold: float = K.OFFER_CRITICAL_MIN_MONTHLY) -> DataFrame:
    return df.withColumn("Retention_Offer", X.retention_offer("Risk_Level", "MonthlyCharges", threshold))


def attach_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Attach Cluster_Name from the k-row naming table (broadcast; k is a parameter)."""
    return df.join(F.broadcast(names.select("Cluster", "Cluster_Name")), "Cluster", "left")


def scored_table(df: DataFrame, names: DataFrame | None = None,
                 offer_threshold: float = K.OFFER_CRITICAL_MIN_MONTHLY) -> DataFrame:
    """All columns + Cluster_Name, Risk_Level, Priority_Score, Retention_Offer."""
    out = df
    if names is not None:
        out = attach_names(out, names)
    out = risk_level(out)
    out = priority_score(out)
    return retention_offer(out, offer_threshold)


# ---------------------------------------------------------------------------------------
# summaries
# ---------------------------------------------------------------------------------------
def _revenue(c) -> F.Column:
    return F.coalesce(F.sum(X.dec_money(c)), F.lit(0).cast("decimal(28,2)")).cast("double")


def cluster_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("Cluster", "Cluster_Name").agg(
        F.count(F.lit(1)).alias("Customers"),
        F.avg("tenure").alias("Avg_Tenure"),
        F.avg("MonthlyCharges").alias("Avg_MonthlyCharges"),
        (F.avg("Churn") * 100).alias("Actual_Churn_Rate"),
        (F.avg("Predicted_Churn") * 100).alias("Predicted_Churn_Rate"),
        _revenue(F.when(F.col("Predicted_Churn") == 1, F.col("MonthlyCharges"))).alias("Revenue_At_Risk"))


def risk_summary(df: DataFrame, key: str = "customerID") -> DataFrame:
    """Per tier in fixed order; tiers with no rows do not appear."""
    counted = F.count(key) if key in df.columns else F.count(F.lit(1))
    return df.groupBy("Risk_Level").agg(
        counted.alias("Customers"),
        F.avg("MonthlyCharges").alias("Avg_Monthly_Charges"),
        _revenue("MonthlyCharges").alias("Revenue_At_Risk"),
        F.avg("Churn_Probability").alias("Avg_Probability"),
    ).withColumn("Risk_Order", X.risk_order("Risk_Level")).orderBy("Risk_Order")


def risk_by_cluster(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("Predicted_Churn") == 1).groupBy("Cluster")
            .agg(F.count(F.lit(1)).alias("At_Risk_Customers"), _revenue("MonthlyCharges").alias("Revenue_At_Risk")))


def tier_counts(df: DataFrame) -> DataFrame:
    return (df.groupBy("Risk_Level").agg(F.count(F.lit(1)).alias("Customers"))
            .withColumn("Risk_Order", X.risk_order("Risk_Level")).orderBy("Risk_Order"))


def tier_revenue(df: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    return (df.groupBy("Risk_Level").agg(_revenue("MonthlyCharges").alias("_usd"))
            .withColumn("Revenue", X.convert_currency("_usd", currency, rate)).drop("_usd")
            .withColumn("Risk_Order", X.risk_order("Risk_Level")).orderBy("Risk_Order"))


def tier_priority(df: DataFrame) -> DataFrame:
    return (df.groupBy("Risk_Level").agg(F.avg("Priority_Score").alias("Avg_Priority_Score"))
            .withColumn("Risk_Order", X.risk_order("Risk_Level")).orderBy("Risk_Order"))


def cluster_probability(df: DataFrame) -> DataFrame:
    return df.groupBy("Cluster").agg(F.avg("Churn_Probability").alias("Avg_Churn_Probability"))


def top_customers(df: DataFrame, n: int = 10, key: str = "customerID") -> DataFrame:
    """Top-n by priority (a top-k report: the limit is the feature)."""
    return df.orderBy(F.col("Priority_Score").desc(), F.col(key).asc()).limit(n)


def churn_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("Total_Customers"),
        F.sum("Churn").cast("bigint").alias("Actual_Churned"),
        F.sum("Predicted_Churn").cast("bigint").alias("Predicted_Churners"),
        (F.avg("Churn") * 100).alias("Churn_Rate_Pct"))


def revenue_at_risk(df: DataFrame) -> DataFrame:
    monthly = F.coalesce(F.sum(F.when(F.col("Predicted_Churn") == 1, X.dec_money("MonthlyCharges"))),
                         F.lit(0).cast("decimal(28,2)"))
    return df.agg(monthly.cast("double").alias("Monthly_Revenue_At_Risk"),
                  (monthly * 12).cast("double").alias("Annual_Revenue_At_Risk"))


def business_metrics(df: DataFrame, n_segments: int | None = None, models: DataFrame | None = None) -> DataFrame:
    """The KPI row (one aggregate pass). Model fields come from ``models`` when given."""
    monthly_risk = F.coalesce(F.sum(F.when(F.col("Predicted_Churn") == 1, X.dec_money("MonthlyCharges"))),
                              F.lit(0).cast("decimal(28,2)")).cast("double")
    revenue_total = F.coalesce(F.sum(X.dec_money("MonthlyCharges")), F.lit(0).cast("decimal(28,2)")).cast("double")
    n = F.count(F.lit(1))
    high = F.count(F.when(F.col("Risk_Level").isin("High", "Critical"), 1))
    segs = F.lit(n_segments) if n_segments is not None else F.count_distinct("Cluster")
    base = df.agg(
        n.alias("Total_Customers"),
        F.sum("Churn").cast("bigint").alias("Actual_Churned_Customers"),
        F.sum("Predicted_Churn").cast("bigint").alias("Predicted_Churn_Customers"),
        F.avg("Churn").alias("Churn_Rate"),
        monthly_risk.alias("Revenue_at_Risk"),
        high.alias("High_Risk_Customers"),
        revenue_total.alias("_revenue_total"),
        segs.cast("int").alias("Number_of_Customer_Segments"),
        F.avg("tenure").alias("Average_Customer_Lifetime"),
        F.avg("MonthlyCharges").alias("Average_Monthly_Charges"),
        F.avg("TotalCharges").alias("Average_Customer_Value"),
    )
    out = (base
           .withColumn("Retention_Rate", 1 - F.col("Churn_Rate"))
           .withColumn("Annual_Revenue_Loss", F.col("Revenue_at_Risk") * 12)
           .withColumn("Revenue_Risk_Ratio", F.when(F.col("_revenue_total") != 0,
                                                    F.col("Revenue_at_Risk") / F.col("_revenue_total"))
                       .otherwise(F.lit(0.0)))
           .withColumn("_high_ratio", F.when(F.col("Total_Customers") > 0,
                                             F.col("High_Risk_Customers") / F.col("Total_Customers"))
                       .otherwise(F.lit(0.0))))
    out = health_score(out).drop("_revenue_total", "_high_ratio")
    if models is not None:
        best = models.agg(F.max_by("Model", F.struct("F1_Score", F.col("Model"))).alias("Best_Machine_Learning_Model"),
                          F.max("Accuracy").alias("Best_Model_Accuracy"),
                          F.max("F1_Score").alias("Best_Model_F1"))
        out = with_params(out, best)
    return out


def health_score(df: DataFrame) -> DataFrame:
    """trunc(clip(100 − 85·churn − 30·high ratio − 20·revenue ratio, 1, 100)) and its label."""
    raw = 100 - F.col("Churn_Rate") * 85 - F.col("_high_ratio") * 30 - F.col("Revenue_Risk_Ratio") * 20
    score = F.least(F.greatest(raw, F.lit(1.0)), F.lit(100.0)).cast("int")
    label = None
    for cut, name in K.HEALTH_LABELS:
        label = F.when(F.col("Business_Health_Score") >= cut, name) if label is None else \
            label.when(F.col("Business_Health_Score") >= cut, name)
    return (df.withColumn("Business_Health_Score", score)
            .withColumn("Business_Health_Label", label.otherwise(K.HEALTH_LABEL_LOW)))


def insights(df: DataFrame) -> DataFrame:
    """Five executive sentences as (Insight_No, Executive_Insight); without contract or segment names the fixed words stand in."""
    churned = df.filter(F.col("Predicted_Churn") == 1)
    if "Contract" not in df.columns:
        churned = churned.withColumn("Contract", F.lit(None).cast("string"))
    named = "Cluster_Name" in df.columns
    if not named:
        df = df.withColumn("Cluster_Name", F.lit(None).cast("string"))
    top_contract = group_mode(churned.withColumn("_all", F.lit(1)), ["_all"], "Contract", "top_contract")
    by_name = df.groupBy("Cluster_Name").agg(F.avg("Churn_Probability").alias("p"), F.avg("TotalCharges").alias("v"))
    # by_name has one row per segment name (k rows).
    pick = by_name.agg(
        F.min(F.struct((-F.col("p")).alias("a"), F.col("Cluster_Name").alias("b")))["b"].alias("riskiest"),
        F.min(F.struct((-F.col("v")).alias("a"), F.col("Cluster_Name").alias("b")))["b"].alias("richest"))
    kpi = df.agg(
        (F.avg("Churn") * 100).alias("churn_pct"),
        (F.coalesce(F.sum(F.when(F.col("Predicted_Churn") == 1, X.dec_money("MonthlyCharges"))),
                    F.lit(0).cast("decimal(28,2)")).cast("double")
         / F.sum(X.dec_money("MonthlyCharges")).cast("double") * 100).alias("risk_pct"))
    row = with_params(with_params(kpi, pick), top_contract.drop("_all"))
    fmt = lambda c: X.format_fixed(F.col(c), 1)
    values = {"churn_pct": fmt("churn_pct"), "risk_pct": fmt("risk_pct"), **{n: F.col(n) if named else F.lit(word) for n, word in K.INSIGHT_NO_SEGMENT.items()},
              "top_contract": F.coalesce(F.col("top_contract"), F.lit("Month-to-month"))}

    def filled(template):
        name = next(n for n in values if "{" + n + "}" in template)
        return F.format_string(template.replace("%", "%%").replace("{" + name + "}", "%s"), values[name])
    texts = [filled(t) for t in K.INSIGHT_TEMPLATES]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("Insight_No"), t.alias("Executive_Insight"))
                    for i, t in enumerate(texts)])
    return row.select(F.inline(arr))


def cluster_recommendation(df: DataFrame) -> DataFrame:
    names = df.select("Cluster_Name").distinct()
    expr = None
    for needle, text in K.CLUSTER_RECOMMENDATIONS:
        cond = F.col("Cluster_Name").contains(needle)
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return names.withColumn("Recommendation", expr.otherwise(K.CLUSTER_RECOMMENDATION_DEFAULT))


def convert_currency(df: DataFrame, currency: str = "SAR", rate: float = K.USD_TO_SAR,
                     columns: list[str] | None = None) -> DataFrame:
    """Money columns × rate when the display currency is SAR."""
    known = columns or ["MonthlyCharges", "TotalCharges", "Revenue_At_Risk", "Avg_MonthlyCharges",
                        "Avg_Monthly_Charges"]
    out = df
    for c in known:
        if c in df.columns:
            out = out.withColumn(c, X.convert_currency(c, currency, rate))
    return out


def format_kpis(df: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    """Render every KPI of a one-row metrics frame as text by its name (long form)."""
    types = dict(df.dtypes)
    items = []
    for name in df.columns:
        label = name.replace("_", " ")
        c = F.col(name)
        if any(t in label for t in K.MONEY_NAME_TERMS):
            text = X.format_money(c.cast("double"), currency, rate)
        elif any(t in label for t in K.PERCENT_NAME_TERMS):
            text = X.format_percent(c.cast("double"))
        elif types[name] in ("double", "float"):
            text = F.format_number(X.round_half_up(c, 2), 2)
        elif types[name] in ("int", "bigint"):
            text = F.format_number(c, 0)
        else:
            text = c.cast("string")
        items.append(F.struct(F.lit(label).alias("Metric"), text.alias("Value")))
    return df.select(F.inline(F.array(*items)))


def report_metric_rows(kpi: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    """The executive (Metric, Value) table."""
    fm = lambda c: X.format_money(F.col(c), currency, rate)
    rows = [
        ("Total Customers", F.format_number(F.col("Total_Customers"), 0)),
        ("Churn Rate", X.format_percent("Churn_Rate")),
        ("Retention Rate", X.format_percent("Retention_Rate")),
        ("Revenue at Risk", fm("Revenue_at_Risk")),
        ("Annual Revenue Loss", fm("Annual_Revenue_Loss")),
        ("High-Risk Customers", F.format_number(F.col("High_Risk_Customers"), 0)),
    ]
    if "Best_Machine_Learning_Model" in kpi.columns:
        rows += [("Best ML Model", F.col("Best_Machine_Learning_Model")),
                 ("Best Model Accuracy", X.format_percent("Best_Model_Accuracy"))]
    rows += [
        ("Customer Segments", F.format_number(F.col("Number_of_Customer_Segments"), 0)),
        ("Business Health", F.concat(F.col("Business_Health_Score").cast("string"), F.lit(" / 100 - "),
                                     F.col("Business_Health_Label"))),
    ]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("Row_No"), F.lit(m).alias("Metric"), v.alias("Value"))
                    for i, (m, v) in enumerate(rows)])
    return kpi.select(F.inline(arr))


def report_segment_rows(profile: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    return profile.select(
        F.col("Cluster_Name").alias("Segment"),
        F.format_number(F.col("Customer_Count"), 0).alias("Customers"),
        X.format_money(F.col("Avg_Monthly_Charges"), currency, rate).alias("Monthly_Charges"),
        F.concat(X.format_fixed("Avg_Tenure", 1), F.lit(" months")).alias("Tenure"),
        X.format_percent("Churn_Risk").alias("Churn_Risk"))


def report_model_rows(models: DataFrame) -> DataFrame:
    return models.select("Model", *[X.format_percent(c).alias(c) for c in
                                    ["Accuracy", "Precision", "Recall", "F1_Score", "ROC_AUC"]])


def customer_search(df: DataFrame, pattern: str, key: str = "customerID") -> DataFrame:
    """First customer whose id matches ``pattern`` (case-insensitive regex), with annual revenue."""
    hit = df.filter(F.col(key).cast("string").rlike("(?i)" + pattern))
    return (hit.orderBy(key).limit(1)
            .withColumn("Annual_Revenue", F.col("MonthlyCharges") * 12))


def predictions_extract(df: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    keep = [c for c in ["customerID", "Churn_Probability", "Risk_Level", "Cluster_Name", "MonthlyCharges",
                        "TotalCharges", "Predicted_Churn", "Retention_Offer"] if c in df.columns]
    return convert_currency(df.select(*keep), currency, rate, ["MonthlyCharges", "TotalCharges"])


def cluster_assignments(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in ["customerID", "Cluster", "Cluster_Name"] if c in df.columns])

