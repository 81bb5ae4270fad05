"""Queries for sources/sinks (§2.1), new-customer scoring (§2.11) and the end-to-end job."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnforge.operators import business as B
from churnforge.operators import models as M
from churnforge.operators.stats import union_all
from churnforge.plans.analytics import run_full_analytics, score_new_customers
from churnforge.plans.catalog import query
from churnforge.session import scratch_path
from churnforge.sources import files as IO
from churnforge.sources import fixtures
from churnforge.sources.tables import read_table


@query("scan_csv")
def q_scan_csv(spark, sf):
    """Round trip: the dirty subscriber table written as CSV and read back by extension."""
    path = scratch_path(spark, "subscribers_raw") + ".csv"
    IO.sink_csv(fixtures.subscribers_raw(spark, sf), path)
    return IO.read_dataset(spark, path)


@query("scan_csv_line_breaks")
def q_scan_csv_line_breaks(spark, sf):
    """Round trip of a table whose fields hold line breaks, quotes and commas: raw web pages as CSV."""
    path = scratch_path(spark, "pages") + ".csv"
    IO.sink_csv(read_table(spark, sf, "pages"), path)
    return IO.read_dataset(spark, path, line_breaks=True)


@query("na_tokens_marked")
def q_na_tokens_marked(spark, sf):
    """Every missing-value token in its turn, by tenure, in place of the contract; other values stay."""
    df = fixtures.subscribers_raw(spark, sf)
    turn = F.array(*[F.lit(t) for t in IO.NA_TOKENS], F.lit(" "), F.lit("none"))
    place = F.col("tenure").cast("int") % (len(IO.NA_TOKENS) + 3)
    marked = F.when(place < len(IO.NA_TOKENS) + 2, F.get(turn, place)).otherwise(F.col("Contract"))
    return IO.na_tokens(df.withColumn("Contract", marked)).select("customerID", "Contract")


@query("na_tokens")
def q_na_tokens(spark, sf):
    return IO.na_tokens(fixtures.subscribers_raw(spark, sf))


@query("sink_csv")
def q_sink_csv(spark, sf):
    """Cluster assignments exported as CSV and read back."""
    from churnforge.plans.frames import analysis
    path = scratch_path(spark, "cluster_assignments") + ".csv"
    IO.sink_csv(B.cluster_assignments(analysis(spark, sf)), path)
    return IO.read_dataset(spark, path)


@query("report_tables")
def q_report_tables(spark, sf):
    """Seven report tables written as one directory each and read back: name, rows and fingerprint of every table."""
    from churnforge.plans.frames import analysis, profile
    an = analysis(spark, sf)
    data = M.prepare_training(fixtures.subscribers(spark, sf))
    models = M.compare_models(data, M.model_specs(data.n_train)).metrics
    tables = {"Executive Metrics": B.format_kpis(B.business_metrics(an)), "Model Comparison": models,
              "Predictions": B.predictions_extract(an), "Clusters": profile(spark, sf), "Risk Summary": B.risk_summary(an),
              "Executive Insights": B.insights(an), "Clean Dataset": fixtures.subscribers(spark, sf)}
    paths = IO.report_tables(tables, scratch_path(spark, "report"))
    parts = [IO.dataset_fingerprint(spark.read.parquet(p)).select(F.lit(n).alias("Table"), "rows", "fingerprint") for n, p in paths.items()]
    return union_all(parts)


@query("report_risk_table")
def q_report_risk_table(spark, sf):
    """The risk table as written for the report and read back."""
    from churnforge.plans.frames import analysis
    paths = IO.report_tables({"Risk Summary": B.risk_summary(analysis(spark, sf))}, scratch_path(spark, "report"))
    return spark.read.parquet(paths["Risk Summary"])


@query("dataset_fingerprint")
def q_fingerprint(spark, sf):
    return IO.dataset_fingerprint(fixtures.subscribers(spark, sf))


@query("score_new_customers")
def q_score_new(spark, sf):
    """Fit the production model, then score the subscriber table as new customers (form defaults fill gaps)."""
    subs = fixtures.subscribers(spark, sf)
    data = M.prepare_training(subs)
    model, _ = M.fit_model(data, M.model_specs(data.n_train)[0])
    new = subs.drop("Churn")
    return score_new_customers(new, data, model).withColumn("Top_Factors", F.array_join("Top_Factors", "; "))


def _full(spark, sf):
    return run_full_analytics(fixtures.subscribers(spark, sf))


@query("full_analytics_risk_summary")
def q_full_risk(spark, sf):
    """Risk tiers from the trained production model and k-means segments."""
    return _full(spark, sf).risk_summary


@query("full_analytics_cluster_summary")
def q_full_clusters(spark, sf):
    return _full(spark, sf).cluster_summary
