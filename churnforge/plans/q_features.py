"""Queries for feature engineering (§2.5) and scoring preparation (§2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnforge.operators import clean as C
from churnforge.operators import features as FE
from churnforge.operators import scoring as S
from churnforge.plans.catalog import query
from churnforge.sources import fixtures


def _subs(spark, sf):
    return fixtures.subscribers(spark, sf)


@query("has_service")
def q_has_service(spark, sf):
    return FE.has_service(_subs(spark, sf)).select("customerID", "HasService")


@query("map_target")
def q_map_target(spark, sf):
    return FE.map_target(_subs(spark, sf)).select("customerID", "Churn")


@query("map_binary")
def q_map_binary(spark, sf):
    return FE.map_binary(_subs(spark, sf)).select("customerID", "TechSupport", "MultipleLines", "PhoneService",
                                                  "Partner", "Dependents")


@query("map_binary_segment")
def q_map_binary_segment(spark, sf):
    return FE.map_binary_segment(_subs(spark, sf)).select("customerID", "gender", "Partner", "Dependents",
                                                          "PhoneService")


@query("to_sar")
def q_to_sar(spark, sf):
    return FE.to_sar(_subs(spark, sf)).select("customerID", "MonthlyCharges", "TotalCharges")


@query("one_hot_drop_first")
def q_one_hot_drop_first(spark, sf):
    df = _subs(spark, sf).select("customerID", "gender", "InternetService", "Contract")
    vocab = FE.fit_vocabulary(df, ["gender", "InternetService", "Contract"])
    return FE.one_hot(df, vocab, drop_first=True)


@query("one_hot_full")
def q_one_hot_full(spark, sf):
    from churnforge.functions import constants as K
    df = _subs(spark, sf).select("customerID", *K.SEGMENT_DUMMY_COLUMNS)
    vocab = FE.fit_vocabulary(df, K.SEGMENT_DUMMY_COLUMNS)
    return FE.one_hot(df, vocab, drop_first=False)


@query("coerce_all_numeric")
def q_coerce(spark, sf):
    return FE.coerce_all_numeric(fixtures.subscribers_raw(spark, sf), keep=("customerID",))


@query("churn_features")
def q_churn_features(spark, sf):
    out, _ = FE.churn_features(_subs(spark, sf))
    return out


@query("segment_features")
def q_segment_features(spark, sf):
    out, _, _ = FE.segment_features(_subs(spark, sf))
    return out


@query("split_80_20")
def q_split(spark, sf):
    return FE.split_80_20(_subs(spark, sf)).select("customerID", "is_test")


@query("scale_three")
def q_scale_three(spark, sf):
    feats, _ = FE.churn_features(_subs(spark, sf))
    split = FE.split_80_20(feats)
    scaling = FE.fit_scaling(split.filter(F.col("is_test") == 0), ["tenure", "MonthlyCharges", "TotalCharges"])
    return scaling.apply(split).select("customerID", "is_test", "tenure", "MonthlyCharges", "TotalCharges")


@query("scale_all")
def q_scale_all(spark, sf):
    feats, _, cols = FE.segment_features(_subs(spark, sf))
    return FE.fit_scaling(feats, cols).apply(feats)


@query("balanced_weights")
def q_balanced_weights(spark, sf):
    feats, _ = FE.churn_features(_subs(spark, sf))
    train = FE.split_80_20(feats).filter(F.col("is_test") == 0)
    return FE.balanced_weights(train).select("customerID", "Churn", "weight")


@query("scale_pos_weight")
def q_scale_pos_weight(spark, sf):
    feats, _ = FE.churn_features(_subs(spark, sf))
    return FE.scale_pos_weight(FE.split_80_20(feats).filter(F.col("is_test") == 0))


@query("encoded_feature_count")
def q_encoded_feature_count(spark, sf):
    cleaned, _ = C.smart_clean(fixtures.subscribers_raw(spark, sf), with_scores=False)
    return FE.encoded_feature_count(cleaned)


@query("align_features")
def q_align_features(spark, sf):
    subs = _subs(spark, sf)
    _, enc = FE.churn_features(subs)
    partial, _ = FE.churn_features(subs.drop("Dependents", "MultipleLines"), enc)
    return partial


@query("prepare_new_customers")
def q_prepare_new_customers(spark, sf):
    """New-customer rows with gaps (some without tenure, contract or payment) filled with the form defaults."""
    subs = _subs(spark, sf)
    _, enc = FE.churn_features(subs)
    last = F.substring("customerID", -1, 1)
    gaps = {"tenure": "012", "Contract": "234", "PaymentMethod": "456"}
    given = subs.drop("Churn").withColumns({c: F.when(~last.isin(*at), F.col(c)) for c, at in gaps.items()})
    newc = S.prepare_new_customers(given)
    out, _ = FE.churn_features(newc, enc)
    return out
