"""Queries for cleaning (§2.2) and data quality (§2.3) on the dirty subscriber table."""

from __future__ import annotations

from churnforge.operators import clean as C
from churnforge.operators import quality as Q
from churnforge.plans.catalog import query
from churnforge.sources import fixtures


def _raw(spark, sf):
    return fixtures.subscribers_raw(spark, sf)


@query("subscribers_raw")
def q_raw(spark, sf):
    return _raw(spark, sf)


@query("blank_to_null")
def q_blank(spark, sf):
    return C.blank_to_null(_raw(spark, sf))


@query("normalize_money")
def q_money(spark, sf):
    return C.normalize_money(C.blank_to_null(_raw(spark, sf)))


@query("repair_types")
def q_repair(spark, sf):
    out, _ = C.repair_types(C.blank_to_null(_raw(spark, sf)))
    return out


@query("dedup_exact")
def q_dedup(spark, sf):
    return C.dedup_exact(C.blank_to_null(_raw(spark, sf)))


@query("fill_total_zero")
def q_fill(spark, sf):
    return C.fill_total_zero(C.blank_to_null(_raw(spark, sf)))


@query("impute_median")
def q_median(spark, sf):
    return C.impute_median(C.normalize_money(C.blank_to_null(_raw(spark, sf))))


@query("impute_mode")
def q_mode(spark, sf):
    return C.impute_mode(C.blank_to_null(_raw(spark, sf)))


@query("drop_constant")
def q_drop_constant(spark, sf):
    out, _ = C.drop_constant(C.blank_to_null(_raw(spark, sf)))
    return out


@query("clip_iqr")
def q_clip(spark, sf):
    out, _ = C.clip_iqr(C.fill_total_zero(C.dedup_exact(C.blank_to_null(_raw(spark, sf)))))
    return out


@query("smart_clean")
def q_smart_clean(spark, sf):
    out, _ = C.smart_clean(_raw(spark, sf), with_scores=False)
    return out


@query("cleaning_summary")
def q_cleaning_summary(spark, sf):
    _, rep = C.smart_clean(_raw(spark, sf))
    return rep.to_frame(spark)


@query("null_rows")
def q_null_rows(spark, sf):
    return C.null_rows(fixtures.subscribers(spark, sf))


@query("drop_columns")
def q_drop_columns(spark, sf):
    return C.drop_columns(fixtures.subscribers(spark, sf), ["customerID", "PaperlessBilling", "PaymentMethod"])


def _issues(df, target="Churn"):
    """The issue table with its column lists as text."""
    from pyspark.sql import functions as F
    return Q.quality_issues(df, target).withColumn("Columns", F.array_join("Columns", "; "))


@query("quality_issues")
def q_quality_issues(spark, sf):
    return _issues(_raw(spark, sf))


@query("quality_score")
def q_quality_score(spark, sf):
    return Q.quality_score(_raw(spark, sf))


@query("quality_issues_clean_table")
def q_quality_issues_clean(spark, sf):
    """The detector on the clean subscriber table (no missing/duplicate rows)."""
    return _issues(fixtures.subscribers(spark, sf))


@query("quality_issues_orders")
def q_quality_issues_orders(spark, sf):
    """The detector on a generic table (orders: ids, text, money, a timestamp; no target)."""
    from churnforge.sources.tables import read_table
    return _issues(read_table(spark, sf, "orders"), target="Churn")


@query("dedup_exact_lineitem")
def q_dedup_lineitem(spark, sf):
    from churnforge.sources.tables import read_table
    return C.dedup_exact(read_table(spark, sf, "lineitem"))


# one key per detector rule (each returns that rule's issue row, if raised)
_RULES = {
    "q_missing": "Missing values detected",
    "q_duplicates": "Duplicate customer rows",
    "q_numeric_text": "Numeric fields stored as text",
    "q_constant": "Constant columns",
    "q_high_cardinality": "High-cardinality categorical fields",
    "q_correlated": "Highly correlated features",
    "q_outliers": "Outliers detected",
    "q_imbalance": "Imbalanced target classes",
}


def _rule_query(title):
    def run(spark, sf):
        from pyspark.sql import functions as F
        return _issues(_raw(spark, sf)).filter(F.col("Issue") == title)
    return run


for _key, _title in _RULES.items():
    query(_key)(_rule_query(_title))


@query("quality_issues_lineitem")
def q_quality_issues_lineitem(spark, sf):
    """The detector on lineitem (correlated money/quantity columns, flags, a timestamp)."""
    from churnforge.sources.tables import read_table
    return _issues(read_table(spark, sf, "lineitem"), target="Churn")


@query("q_correlated_measures")
def q_correlated_measures(spark, sf):
    """The correlation rule on a table where it fires for many pairs."""
    from pyspark.sql import functions as F
    return _issues(fixtures.line_measures(spark, sf, "R")).filter(F.col("Issue") == _RULES["q_correlated"])
