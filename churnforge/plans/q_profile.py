"""Queries for profiling / EDA (§2.4), on the subscriber fixtures and on the generic tables."""

from __future__ import annotations

from churnforge.operators import profile as P
from churnforge.plans.catalog import query
from churnforge.sources import fixtures
from churnforge.sources.tables import read_table


@query("dataset_summary")
def q_dataset_summary(spark, sf):
    return P.dataset_summary(fixtures.subscribers_raw(spark, sf))


@query("dataset_summary_customer")
def q_dataset_summary_customer(spark, sf):
    return P.dataset_summary(read_table(spark, sf, "customer"))


@query("preview")
def q_preview(spark, sf):
    return P.preview(fixtures.subscribers(spark, sf), 100, "customerID")


@query("describe_all")
def q_describe_all(spark, sf):
    return P.describe_all(read_table(spark, sf, "customer"))


@query("describe_all_subscribers")
def q_describe_all_subscribers(spark, sf):
    return P.describe_all(fixtures.subscribers_raw(spark, sf))


@query("missing_by_column")
def q_missing_by_column(spark, sf):
    return P.missing_by_column(fixtures.subscribers_raw(spark, sf))


@query("missing_by_column_events")
def q_missing_by_column_events(spark, sf):
    return P.missing_by_column(read_table(spark, sf, "events"))


@query("corr_matrix")
def q_corr_matrix(spark, sf):
    return P.corr_matrix(fixtures.subscribers(spark, sf))


@query("corr_matrix_lineitem")
def q_corr_matrix_lineitem(spark, sf):
    return P.corr_matrix(read_table(spark, sf, "lineitem"))


@query("corr_matrix_measures")
def q_corr_matrix_measures(spark, sf):
    """32 columns, 24 of them with missing values: 496 pairs in one Gram pass."""
    return P.corr_matrix(fixtures.line_measures(spark, sf))


@query("describe_all_orders")
def q_describe_all_orders(spark, sf):
    return P.describe_all(read_table(spark, sf, "orders"))


@query("describe_all_lineitem")
def q_describe_all_lineitem(spark, sf):
    return P.describe_all(read_table(spark, sf, "lineitem"))


@query("schema_table")
def q_schema_table(spark, sf):
    return P.schema_table(fixtures.subscribers_raw(spark, sf))


@query("missing_map_sample")
def q_missing_map_sample(spark, sf):
    return P.missing_map_sample(fixtures.subscribers_raw(spark, sf), 500, "customerID")


@query("missing_patterns")
def q_missing_patterns(spark, sf):
    return P.missing_patterns(fixtures.subscribers_raw(spark, sf))


@query("histograms")
def q_histograms(spark, sf):
    return P.histograms(fixtures.subscribers_raw(spark, sf), 30)


@query("histograms_orders")
def q_histograms_orders(spark, sf):
    return P.histograms(read_table(spark, sf, "orders"), 30)


@query("box_stats")
def q_box_stats(spark, sf):
    return P.box_stats(fixtures.subscribers_raw(spark, sf))


@query("box_stats_lineitem")
def q_box_stats_lineitem(spark, sf):
    return P.box_stats(read_table(spark, sf, "lineitem"))


@query("class_distribution")
def q_class_distribution(spark, sf):
    return P.class_distribution(fixtures.subscribers(spark, sf))


@query("churn_rate_by_category")
def q_churn_rate_by_category(spark, sf):
    return P.churn_rate_by_category(fixtures.subscribers(spark, sf))


@query("kde_by_class")
def q_kde_tenure(spark, sf):
    return P.kde_by_class(fixtures.subscribers(spark, sf), "tenure")


@query("kde_by_class_monthly")
def q_kde_monthly(spark, sf):
    return P.kde_by_class(fixtures.subscribers(spark, sf), "MonthlyCharges")
