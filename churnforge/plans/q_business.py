"""Queries over the fixed-score analysis frame (business KPIs, dashboards, exports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnforge.operators import business as B
from churnforge.operators import dashboard as D
from churnforge.operators import profiles as P
from churnforge.plans.catalog import query
from churnforge.plans.frames import analysis, profile
from churnforge.sources import fixtures


@query("subscribers")
def q_subscribers(spark, sf):
    return fixtures.subscribers(spark, sf)


@query("risk_level")
def q_risk_level(spark, sf):
    an = B.analysis_frame(fixtures.scored(spark, sf))
    return B.risk_level(an).select("customerID", "Churn_Probability", "Risk_Level")


@query("priority_score")
def q_priority(spark, sf):
    an = B.analysis_frame(fixtures.scored(spark, sf))
    return B.priority_score(an).select("customerID", "Priority_Score")


@query("retention_offer")
def q_offer(spark, sf):
    an = B.risk_level(B.analysis_frame(fixtures.scored(spark, sf)))
    return B.retention_offer(an).select("customerID", "Risk_Level", "Retention_Offer")


@query("retention_offer_sar")
def q_offer_sar(spark, sf):
    """Offer rule applied to SAR charges (notebook variant: 300 in the table's currency)."""
    an = B.analysis_frame(fixtures.scored(spark, sf))
    an = B.risk_level(B.convert_currency(an, "SAR"))
    return B.retention_offer(an).select("customerID", "MonthlyCharges", "Risk_Level", "Retention_Offer")


@query("scored_table")
def q_scored_table(spark, sf):
    return analysis(spark, sf)


@query("cluster_profile")
def q_cluster_profile(spark, sf):
    an = B.analysis_frame(fixtures.scored(spark, sf))
    return P.cluster_profile(an)


@query("cluster_names")
def q_cluster_names(spark, sf):
    return profile(spark, sf).select("Cluster", "Cluster_Name")


@query("cluster_summary")
def q_cluster_summary(spark, sf):
    return B.cluster_summary(analysis(spark, sf))


@query("risk_summary")
def q_risk_summary(spark, sf):
    return B.risk_summary(analysis(spark, sf))


@query("risk_by_cluster")
def q_risk_by_cluster(spark, sf):
    return B.risk_by_cluster(analysis(spark, sf))


@query("tier_counts")
def q_tier_counts(spark, sf):
    return B.tier_counts(analysis(spark, sf))


@query("tier_revenue")
def q_tier_revenue(spark, sf):
    return B.tier_revenue(analysis(spark, sf), "SAR")


@query("tier_priority")
def q_tier_priority(spark, sf):
    return B.tier_priority(analysis(spark, sf))


@query("cluster_probability")
def q_cluster_probability(spark, sf):
    return B.cluster_probability(analysis(spark, sf))


@query("top_customers")
def q_top_customers(spark, sf):
    return B.top_customers(analysis(spark, sf), 20).select(
        "customerID", "Cluster_Name", "Churn_Probability", "Risk_Level", "Priority_Score", "Retention_Offer")


@query("churn_totals")
def q_churn_totals(spark, sf):
    return B.churn_totals(analysis(spark, sf))


@query("revenue_at_risk")
def q_revenue_at_risk(spark, sf):
    return B.revenue_at_risk(analysis(spark, sf))


@query("business_metrics")
def q_business_metrics(spark, sf):
    return B.business_metrics(analysis(spark, sf))


@query("health_score")
def q_health_score(spark, sf):
    return B.business_metrics(analysis(spark, sf)).select("Business_Health_Score", "Business_Health_Label")


@query("insights")
def q_insights(spark, sf):
    return B.insights(analysis(spark, sf))


@query("cluster_recommendation")
def q_cluster_recommendation(spark, sf):
    return B.cluster_recommendation(analysis(spark, sf))


@query("convert_currency")
def q_convert_currency(spark, sf):
    return B.convert_currency(analysis(spark, sf), "SAR").select("customerID", "MonthlyCharges", "TotalCharges")


@query("format_money_percent")
def q_format_kpis(spark, sf):
    return B.format_kpis(B.business_metrics(analysis(spark, sf)), "SAR")


@query("report_metric_rows")
def q_report_metric_rows(spark, sf):
    return B.report_metric_rows(B.business_metrics(analysis(spark, sf)), "SAR")


@query("report_segment_rows")
def q_report_segment_rows(spark, sf):
    return B.report_segment_rows(profile(spark, sf), "SAR")


@query("predictions_extract")
def q_predictions_extract(spark, sf):
    return B.predictions_extract(analysis(spark, sf), "SAR")


@query("cluster_assignments")
def q_cluster_assignments(spark, sf):
    return B.cluster_assignments(analysis(spark, sf))


@query("customer_search")
def q_customer_search(spark, sf):
    return B.customer_search(analysis(spark, sf), "c0+1234").select(
        "customerID", "Churn_Probability", "Risk_Level", "Cluster_Name", "MonthlyCharges", "TotalCharges",
        "Annual_Revenue", "Retention_Offer")


@query("cluster_sizes")
def q_cluster_sizes(spark, sf):
    return P.cluster_sizes(analysis(spark, sf))


@query("cluster_means")
def q_cluster_means(spark, sf):
    return P.cluster_means(analysis(spark, sf), "SAR")


@query("cluster_shares")
def q_cluster_shares(spark, sf):
    return P.cluster_shares(analysis(spark, sf))


@query("cluster_heatmap")
def q_cluster_heatmap(spark, sf):
    return P.cluster_heatmap(profile(spark, sf))


@query("cluster_radar")
def q_cluster_radar(spark, sf):
    return P.cluster_radar(profile(spark, sf))


@query("revenue_by_segment")
def q_revenue_by_segment(spark, sf):
    return D.revenue_by_segment(analysis(spark, sf), "SAR")


@query("revenue_histogram")
def q_revenue_histogram(spark, sf):
    return D.revenue_histogram(analysis(spark, sf), 36)


@query("revenue_by_tenure")
def q_revenue_by_tenure(spark, sf):
    return D.revenue_by_tenure(analysis(spark, sf), "SAR")


@query("clv_by_segment")
def q_clv_by_segment(spark, sf):
    return D.clv_by_segment(analysis(spark, sf))


@query("prediction_histogram")
def q_prediction_histogram(spark, sf):
    return D.equal_width_histogram(analysis(spark, sf), "Churn_Probability", 30)


@query("risk_factors")
def q_risk_factors(spark, sf):
    from churnforge.operators import scoring as S
    return S.risk_factors(fixtures.subscribers(spark, sf)).select(
        "customerID", F.array_join("Top_Factors", "; ").alias("Top_Factors"))
