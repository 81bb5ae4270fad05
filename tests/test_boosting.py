"""Boosted trees: the same model as MLlib's, in fewer jobs."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from churnforge.operators import boosting as BO
from churnforge.operators import models as M

NAMES = ["a", "b", "c", "d"]
ASKED = dict(labelCol="y", weightCol="w", maxIter=6, stepSize=0.3, maxDepth=4, seed=42)


def _table(spark, n=700, parts=3):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, k, n) for k in (9, 2, 20, 3)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(4 - x[:, 0] - 2 * x[:, 1] + 0.3 * x[:, 2]))).astype(float)
    rows = np.column_stack([x, y, 0.5 + rng.random(n)]).tolist()
    return spark.createDataFrame(rows, [*NAMES, "y", "w"]).repartition(parts).checkpoint()


def _chances(model, df):
    return np.array([r[0] for r in model.transform(df).orderBy(*NAMES, "w").select(vector_to_array("probability")[1]).collect()])


def _pipe(est):
    return Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), est])


@pytest.mark.parametrize("work", [0, BO.PAIR_WORK])
def test_equals_mllib_where_nothing_is_drawn(spark, monkeypatch, work):
    monkeypatch.setattr(BO, "PAIR_WORK", work)
    df = _table(spark)
    want = _chances(_pipe(GBTClassifier(**ASKED)).fit(df), df)
    got = _chances(_pipe(BO.BoostedTrees(**ASKED)).fit(df), df)
    assert np.abs(got - want).max() < 1e-6


def test_two_levels_a_job(spark):
    df, sc = _table(spark), spark.sparkContext
    specs = [s.estimator for s in M.model_specs(700) + M.model_specs(700, weighted=False) if isinstance(s.estimator, GBTClassifier)]
    assert len(specs) == 4
    for est in specs:
        est = est.copy().setLabelCol("y").setMaxIter(8).setMaxDepth(6)
        if est.isSet("weightCol"):
            est.setWeightCol("w")
        sc.setJobGroup(f"boost-{est.uid}", "boost")
        _pipe(est).fit(df)
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"boost-{est.uid}"))
        sc.setJobGroup("other", "other")
        assert jobs <= 8 * 3 + 8  # 8 trees of 6 levels, and the preparation


def test_wide_values_rare_values_and_missing(spark):
    values = np.r_[np.zeros(9990), np.ones(10)]
    assert BO.cuts_of(values, 31).tolist() == [0.5]
    cuts = BO.cuts_of(np.random.default_rng(0).random(5000), 31)
    assert len(cuts) == 31 and (np.diff(cuts) > 0).all()
    assert BO.cuts_of(np.array([3.0, 3.0]), 31).tolist() == []


def test_sampled_fit_learns_and_repeats(spark):
    df = _table(spark)
    est = BO.BoostedTrees(**ASKED | dict(subsamplingRate=0.8, featureSubsetStrategy="0.8", maxIter=30))
    one, two = (_chances(_pipe(est).fit(df), df) for _ in range(2))
    assert (one == two).all()
    y = np.array([r[0] for r in df.orderBy(*NAMES, "w").select("y").collect()])
    assert ((one > 0.5) == y).mean() > 0.8


def test_checkpointed_margins_change_nothing(spark, monkeypatch):
    df = _table(spark)
    want = _chances(_pipe(BO.BoostedTrees(**ASKED)).fit(df), df)
    monkeypatch.setattr(BO, "EVERY", 2)
    monkeypatch.setattr(BO, "MANY", 1)
    monkeypatch.setattr(BO, "BLOCK", 50)
    assert np.abs(_chances(_pipe(BO.BoostedTrees(**ASKED)).fit(df), df) - want).max() < 1e-9


def test_saved_and_loaded(spark, tmp_path):
    df = _table(spark)
    model = _pipe(BO.BoostedTrees(**ASKED)).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert (_chances(PipelineModel.load(str(tmp_path / "m")), df) == _chances(model, df)).all()
    assert abs(model.stages[-1].featureImportances.toArray().sum() - 1) < 1e-9


def test_one_class_empty_and_wrong_labels(spark):
    df = _table(spark)
    one = _pipe(BO.BoostedTrees(**ASKED)).fit(df.filter("y = 1"))
    assert (_chances(one, df) > 0.5).all()
    with pytest.raises(ValueError):
        _pipe(BO.BoostedTrees(**ASKED)).fit(df.limit(0))
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        _pipe(BO.BoostedTrees(**ASKED)).fit(df.selectExpr(*NAMES, "w", "if(a = 3, null, y) as y"))


def test_short_fits_are_done_before_the_long_ones_start(spark, monkeypatch):
    from types import SimpleNamespace
    log = []

    def fit(data, spec):
        log.append(("start", spec.name))
        log.append(("end", spec.name))
        raise RuntimeError("only the order is tried")

    monkeypatch.setattr(M, "fit_model", fit)
    specs = M.model_specs(1000)
    res = M.compare_models(SimpleNamespace(train=spark.range(1)), specs)
    long = {"Decision Tree", "Random Forest"}
    first_long = min(log.index(("start", n)) for n in long)
    assert all(log.index(("end", s.name)) < first_long for s in specs if s.name not in long)
    assert set(res.errors) == {s.name for s in specs}


def test_long_fits_side_by_side_do_not_fail(spark, monkeypatch):
    """Checkpoints are let go in threads that know of no active session."""
    from types import SimpleNamespace
    df = _table(spark).selectExpr(*NAMES, "y as Churn", "w as weight", "1.0 as pos_weight", "string(a) as customerID")
    monkeypatch.setattr(BO, "EVERY", 2)
    specs = [s for s in M.model_specs(700) if isinstance(s.estimator, BO.BoostedTrees)]
    for s in specs:
        s.estimator._set(maxIter=6, maxDepth=2)
    data = SimpleNamespace(train=df, test=df, feature_columns=NAMES)
    res = M.compare_models(data, specs)
    assert res.errors == {} and len(res.models) == 2
