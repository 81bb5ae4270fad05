"""The end-to-end analytics job: normalise → train and compare models → score
every customer → segment → business tables and KPIs.

Every stage is a Spark job. Predictions and cluster ids are attached to the
normalised table by a row number that is stored with it: the three inputs are
derived from the same table, so the joins are one to one and AQE plans them by
measured size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions import constants as K
from churnforge.operators import business as B
from churnforge.operators import clean as C
from churnforge.operators import evaluate as E
from churnforge.operators import models as M
from churnforge.operators import profiles as P
from churnforge.operators import scoring as S
from churnforge.operators import segment as SG
from churnforge.operators import features as FE


ROW = "_row"


@dataclass
class AnalyticsResult:
    analysis: DataFrame          # scored table: all columns + prediction, cluster, name, tier, priority, offer
    model_metrics: DataFrame
    confusion: DataFrame         # production model, test part
    curves: DataFrame            # ROC and precision-recall points of every model, test part
    importance: DataFrame
    learning_curve: DataFrame
    profile: DataFrame           # k rows with names
    segmentation_metrics: DataFrame
    loadings: DataFrame
    cluster_summary: DataFrame
    risk_summary: DataFrame
    business_metrics: DataFrame
    insights: DataFrame
    training: M.TrainingData
    production_model: object
    segmentation: SG.SegmentationFit


def run_full_analytics(raw: DataFrame, key: str = "customerID", k: int = 3, n_init: int = 10) -> AnalyticsResult:
    """All five models, ``n_init`` k-means starts, every row: rows with a shared or missing key are analysed like all others.

    Rows are numbered on the checkpointed input (the number is stored with them, so it cannot
    change), and predictions and clusters come back by that number.
    """
    C.require_columns(raw, ["Churn", "MonthlyCharges", "TotalCharges", "tenure", key])
    clean = C.fill_total_zero(C.normalize_money(C.blank_to_null(raw)))
    model_df = FE.split_80_20(clean, key).withColumn(ROW, F.monotonically_increasing_id()).checkpoint(eager=True)
    data = M.prepare_training(model_df, ROW)
    cmp = M.compare_models(data, M.model_specs(data.n_train))
    name = "Logistic Regression"
    if name not in cmp.models:
        raise RuntimeError(f"the production model could not be fitted: {cmp.errors.get(name)}")
    lr = cmp.models[name]
    preds = M.predict(lr, data.all_rows, keep=(ROW,))
    seg = SG.segment(model_df.drop("is_test"), ROW, k, n_init)
    an = B.analysis_frame(model_df.drop("is_test"))
    an = an.join(preds, ROW).join(seg.points.select(ROW, "Cluster"), ROW).drop(ROW).checkpoint(eager=True)
    profile = P.cluster_names(P.cluster_profile(an))
    scored = B.scored_table(an, profile)
    return AnalyticsResult(
        analysis=scored, model_metrics=cmp.metrics,
        confusion=E.confusion(cmp.test_predictions.filter(F.col("Model") == name)),
        curves=M.curves(cmp.test_predictions),
        importance=M.feature_importance(lr, data.feature_columns, len(data.feature_columns)),
        learning_curve=M.learning_curve(data, key=ROW), profile=profile,
        segmentation_metrics=SG.segmentation_metrics(seg.points), loadings=SG.pca_loadings(seg.pca, len(seg.pca.components[0])),
        cluster_summary=B.cluster_summary(scored), risk_summary=B.risk_summary(scored, key),
        business_metrics=B.business_metrics(scored, models=cmp.metrics), insights=B.insights(scored),
        training=data, production_model=lr, segmentation=seg)


def score_new_customers(new: DataFrame, data: M.TrainingData, model, currency: str = "USD",
                        rate: float = K.USD_TO_SAR, key: str = "customerID") -> DataFrame:
    """Probability (p ≥ .5 verdict), tier, advice and risk factors for any table of new customers.

    A single row-wise chain (no join, no aggregate), so it also runs on a stream.
    """
    filled = S.risk_factors(S.prepare_new_customers(new, currency, rate))
    feats, _ = FE.churn_features(filled, data.encoding, key=key, passthrough=("Top_Factors",))
    scaled = data.scaling.apply(feats)
    preds = M.predict(model, scaled, keep=(key, "Top_Factors")).withColumnRenamed("Churn_Probability", "Probability")
    return S.verdict(preds).drop("Predicted_Churn")
