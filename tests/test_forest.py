"""Random forests on blocks: MLlib's model where nothing is drawn, sums and routes against plain loops."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from churnforge.operators import bins as BI
from churnforge.operators import boosting as BO
from churnforge.operators import forest as FO
from churnforge.operators import models as M
from test_boosting import NAMES, _chances, _pipe, _table

PLAIN = dict(labelCol="y", weightCol="w", numTrees=1, maxDepth=6, minInstancesPerNode=2, bootstrap=False, featureSubsetStrategy="all", seed=42)


def test_sums_by_bin_are_those_of_each_feature_alone():
    rng, sizes, n = np.random.default_rng(1), np.array([7, 2, 1, 32, 2, 2, 40, 2]), 4000
    codes = np.array([rng.integers(0, s, n) for s in sizes], np.uint8)
    node, v = rng.integers(0, 5, n), rng.random(n)
    starts = np.r_[0, sizes.cumsum()]
    for rows in (100, 20_000, 10 ** 7):
        sums = BI.Sums(sizes, 5, rows)
        joint = sums.empty(2)
        for part in (slice(0, 1500), slice(1500, n)):
            sums.add(joint, sums.packed(codes[:, part]), node[part], [np.ones(n)[part], v[part]])
        got = sums.by_bin(joint)
        for j, s in enumerate(sizes):
            want = np.zeros((2, 5, s))
            np.add.at(want[0], (node, codes[j]), 1)
            np.add.at(want[1], (node, codes[j]), v)
            assert np.allclose(got[:, :, starts[j]:starts[j + 1]], want, atol=1e-9)


def test_routes_are_those_of_single_rows():
    rng, depth, n = np.random.default_rng(2), 9, 1003
    codes = rng.integers(0, 6, (4, n)).astype(np.uint8)
    tree = BI.Tree(depth)
    for k in range(2 ** depth - 1):
        if (k == 0 or tree.cut[(k - 1) // 2] < 255) and rng.random() < 0.9:
            tree.feature[k], tree.cut[k] = rng.integers(0, 4), rng.integers(0, 5)
    for levels in range(depth + 1):
        want = np.zeros(n, int)
        for level in range(levels):
            k = want + 2 ** level - 1
            want = 2 * want + (codes[tree.feature[k], np.arange(n)] > tree.cut[k])
        assert (tree.route(BI.Tests(codes), levels) == want).all()


@pytest.mark.parametrize("weighted", [True, False])
def test_equals_mllib_where_nothing_is_drawn(spark, weighted):
    df, asked = _table(spark), dict(PLAIN)
    if not weighted:
        asked.pop("weightCol")
    want = _chances(_pipe(RandomForestClassifier(**asked)).fit(df), df)
    got = _chances(_pipe(FO.BaggedTrees(**asked)).fit(df), df)
    assert np.abs(got - want).max() < 1e-6


def test_weights_by_class_and_by_row_give_one_model(spark, monkeypatch):
    df = _table(spark).withColumn("w", F.when(F.col("y") == 1, 2.5).otherwise(0.75))
    est = FO.BaggedTrees(**PLAIN | dict(numTrees=5, bootstrap=True, featureSubsetStrategy="sqrt"))
    want = _chances(_pipe(est).fit(df), df)
    monkeypatch.setattr(FO, "_weights_by_class", lambda blocks: None)
    monkeypatch.setattr(FO, "SENT", 4)  # a tree or two a job
    assert np.abs(_chances(_pipe(est).fit(df), df) - want).max() < 1e-9


def test_drawn_forest_is_as_good_as_mllib_and_repeats(spark):
    df = _table(spark, n=4000)
    asked = PLAIN | dict(numTrees=40, bootstrap=True, featureSubsetStrategy="sqrt", maxDepth=5)
    y = np.array([r[0] for r in df.orderBy(*NAMES, "w").select("y").collect()])
    one, two = (_chances(_pipe(FO.BaggedTrees(**asked)).fit(df), df) for _ in range(2))
    other, again = (_chances(_pipe(RandomForestClassifier(**asked | dict(seed=k))).fit(df), df) for k in (42, 7))
    assert (one == two).all()
    assert np.abs(one - other).mean() < 2 * np.abs(other - again).mean()
    assert abs((one - other).mean()) < 0.01
    assert abs(((one > 0.5) == y).mean() - ((other > 0.5) == y).mean()) < 0.02


def test_draws_have_the_poisson_shares():
    times = FO.draws_of(1.0, True)
    assert abs(times.mean() - 1) < 1e-3 and abs((times == 0).mean() - np.exp(-1)) < 2 ** -15 and times.max() >= 7
    assert FO.draws_of(1.0, False) is None
    assert abs(FO.draws_of(0.3, False).mean() - 0.3) < 1e-4


def test_a_job_for_each_level_of_all_trees(spark):
    df, sc = _table(spark), spark.sparkContext
    est = [s.estimator for s in M.model_specs(700) if s.name == "Random Forest"][0].copy().setLabelCol("y").setWeightCol("w")
    sc.setJobGroup(f"forest-{est.uid}", "forest")
    _pipe(est).fit(df)
    jobs = len(sc.statusTracker().getJobIdsForGroup(f"forest-{est.uid}"))
    sc.setJobGroup("other", "other")
    assert isinstance(est, FO.BaggedTrees) and jobs <= est.getMaxDepth() + 6


def test_saved_one_class_empty_and_too_deep(spark, tmp_path):
    df, est = _table(spark), FO.BaggedTrees(**PLAIN | dict(numTrees=3, bootstrap=True))
    model = _pipe(est).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert (_chances(PipelineModel.load(str(tmp_path / "m")), df) == _chances(model, df)).all()
    assert abs(model.stages[-1].featureImportances.toArray().sum() - 1) < 1e-9
    assert (_chances(_pipe(est).fit(df.filter("y = 1")), df) == 1).all()
    with pytest.raises(ValueError):
        _pipe(est).fit(df.limit(0))
    with pytest.raises(ValueError, match="depth"):
        _pipe(est.copy().setMaxDepth(30)).fit(df)


def test_sums_by_pair_are_those_of_two_features_alone():
    rng, n = np.random.default_rng(3), 3000
    for sizes in (np.array([7, 2, 1, 32, 2, 2, 40, 2]), np.array([3, 2])):
        codes = np.array([rng.integers(0, s, n) for s in sizes], np.uint8)
        node, v = rng.integers(0, 3, n), rng.random(n)
        starts = BO._starts(sizes, True)
        width = starts.pop(())
        sums = BI.PairSums(sizes, 3)
        joint = sums.empty(2)
        sums.add(joint, sums.packed(codes), node, [np.ones(n), v])
        got = sums.by_pair(joint, starts, width)
        for (i, j), start in starts.items():
            want = np.zeros((2, 3, sizes[i], sizes[j]))
            np.add.at(want[0], (node, codes[i], codes[j]), 1)
            np.add.at(want[1], (node, codes[i], codes[j]), v)
            assert np.allclose(got[:, :, start:start + sizes[i] * sizes[j]], want.reshape(2, 3, -1), atol=1e-9)
