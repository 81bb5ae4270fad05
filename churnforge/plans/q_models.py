"""Queries for supervised models (§2.6) and evaluation (§2.7).

Trained models have no SQL twin (rows-only check); the evaluation operators
are also registered on the fixed-score fixture, where DuckDB can check them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnforge.operators import business as B
from churnforge.operators import evaluate as E
from churnforge.operators import features as FE
from churnforge.operators import models as M
from churnforge.plans.catalog import query
from churnforge.session import scratch_path
from churnforge.sources import fixtures


def _data(spark, sf):
    return M.prepare_training(fixtures.subscribers(spark, sf))


def _one(spark, sf, name):
    data = _data(spark, sf)
    spec = [s for s in M.model_specs(data.n_train) if s.name == name]
    return M.compare_models(data, spec).metrics


@query("fit_lr_balanced")
def q_fit_lr(spark, sf):
    data = _data(spark, sf)
    model, _ = M.fit_model(data, M.model_specs(data.n_train)[0])
    return M.predict(model, data.test)


@query("fit_tree")
def q_fit_tree(spark, sf):
    return _one(spark, sf, "Decision Tree")


@query("fit_forest")
def q_fit_forest(spark, sf):
    return _one(spark, sf, "Random Forest")


@query("fit_gbt")
def q_fit_gbt(spark, sf):
    return _one(spark, sf, "Gradient Boosting")


@query("fit_gbt_pos_weight")
def q_fit_gbt_pos(spark, sf):
    return _one(spark, sf, "Boosted (pos-weight)")


@query("fit_unweighted")
def q_fit_unweighted(spark, sf):
    data = _data(spark, sf)
    return M.compare_models(data, M.model_specs(data.n_train, weighted=False)).metrics


@query("model_comparison")
def q_model_comparison(spark, sf):
    data = _data(spark, sf)
    return M.compare_models(data, M.model_specs(data.n_train)).metrics


@query("best_model")
def q_best_model(spark, sf):
    data = _data(spark, sf)
    return M.best_model(M.compare_models(data, M.model_specs(data.n_train)).metrics)


@query("predict_all")
def q_predict_all(spark, sf):
    data = _data(spark, sf)
    model, _ = M.fit_model(data, M.model_specs(data.n_train)[0])
    return M.predict(model, data.all_rows)


@query("feature_importance")
def q_feature_importance(spark, sf):
    data = _data(spark, sf)
    model, _ = M.fit_model(data, M.model_specs(data.n_train)[0])
    return M.feature_importance(model, data.feature_columns, 20)


@query("learning_curve")
def q_learning_curve(spark, sf):
    return M.learning_curve(_data(spark, sf))


@query("save_load_model")
def q_save_load(spark, sf):
    """Model, scaling and vocabulary saved and loaded again, which then score the raw rows of the test part."""
    data = _data(spark, sf)
    model, _ = M.fit_model(data, M.model_specs(data.n_train)[0])
    path = scratch_path(spark, "lr-model")
    M.ChurnModel(data.encoding, data.scaling, model).save(path)
    raw = FE.split_80_20(fixtures.subscribers(spark, sf)).filter(F.col("is_test") == 1).drop("is_test")
    return M.ChurnModel.load(path).score(raw)


# --- evaluation on the fixed-score fixture (test split) --------------------------------------
def _scored_test(spark, sf):
    an = B.analysis_frame(fixtures.scored(spark, sf))
    return FE.split_80_20(an).filter(F.col("is_test") == 1)


@query("confusion")
def q_confusion(spark, sf):
    return E.confusion(_scored_test(spark, sf))


@query("acc_prec_rec_f1")
def q_metrics(spark, sf):
    return E.classification_metrics(_scored_test(spark, sf))


@query("roc_auc")
def q_roc_auc(spark, sf):
    return E.roc_auc(_scored_test(spark, sf))


@query("roc_curve")
def q_roc_curve(spark, sf):
    return E.roc_curve(_scored_test(spark, sf))


@query("pr_curve")
def q_pr_curve(spark, sf):
    return E.pr_curve(_scored_test(spark, sf))


@query("actual_vs_predicted")
def q_actual_vs_predicted(spark, sf):
    return E.actual_vs_predicted(_scored_test(spark, sf))


@query("report_model_rows")
def q_report_model_rows(spark, sf):
    from churnforge.operators import business as B
    data = _data(spark, sf)
    return B.report_model_rows(M.compare_models(data, M.model_specs(data.n_train)).metrics)


@query("importance_top15")
def q_importance_top15(spark, sf):
    data = _data(spark, sf)
    model, _ = M.fit_model(data, M.model_specs(data.n_train)[0])
    return M.feature_importance(model, data.feature_columns, 15)


@query("model_curves")
def q_model_curves(spark, sf):
    """ROC and precision-recall points of every fitted model on the test part."""
    data = _data(spark, sf)
    preds = M.compare_models(data, M.model_specs(data.n_train)).test_predictions
    return M.curves(preds)


@query("learning_curve_table")
def q_learning_curve_table(spark, sf):
    return M.learning_curve(_data(spark, sf)).select("Training_Size", "Training_F1", "Validation_F1")
