"""The shared Newton loop of the learning curve against single NumPy fits."""

import numpy as np
import pytest

from churnforge.operators import newton
from test_models import _newton_lr


def table(spark, n=700, seed=1, parts=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1]
    y = (x @ [1.0, -0.3, 4.0] - 1 + rng.logistic(size=n) > 0).astype(int)
    rows = [(int(k), *map(float, v), int(c)) for k, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key long, a double, `b.c` double, d double, y int").repartition(parts, "key"), ["a", "b.c", "d"]


def f1(said, y):
    tp, fp, fn = (said & (y == 1)).sum(), (said & (y == 0)).sum(), (~said & (y == 1)).sum()
    return 2 * tp / (2 * tp + fp + fn)


def test_equals_single_fits_on_stratified_nested_folds(spark):
    df, cols = table(spark)
    rows = newton.ranked(df, cols, "y", "key")
    pdf = rows.toPandas()
    count = pdf["_class"].value_counts().to_dict()
    for c, n in count.items():
        assert sorted(pdf[pdf["_class"] == c]["_rank"]) == list(range(n))
    runs = newton.Runs(count, 3, (0.2, 0.6, 1.0))
    fitted = newton.fit(rows, runs, 3)
    x, y, rank = pdf[["x0", "x1", "x2"]].to_numpy(), pdf["_class"].to_numpy(), pdf["_rank"].to_numpy()
    held_by, scores = np.zeros(len(y), int), {}
    for r, (fold, size) in enumerate(runs.pairs):
        train, held = runs.sides(y, rank, r)
        assert not (train & held).any() and abs(held[y == 1].sum() - count[1] / 3) < 1 and abs(held[y == 0].sum() - count[0] / 3) < 1
        held_by += held
        if size == 1.0:
            assert (train | held).all()
        elif runs.pairs[r + 1][0] == fold:
            assert (runs.sides(y, rank, r + 1)[0] >= train).all()
        w = np.where(y == 1, train.sum() / (2 * train[y == 1].sum()), train.sum() / (2 * train[y == 0].sum()))
        want = _newton_lr(x[train], y[train], w[train])
        beta, passes, ended = fitted[r]
        assert ended and passes <= 15 and np.allclose(beta, want, atol=1e-6)
        said = np.c_[x, np.ones(len(x))] @ want > 0
        scores.setdefault(size, []).append((f1(said[train], y[train]), f1(said[held], y[held])))
    assert (held_by == 3).all()  # each row is held out once for every size
    got = newton.learning_curve(df, cols, "y", "key", 3, (0.2, 0.6, 1.0)).collect()
    for r in got:
        assert np.allclose([r.Training_F1, r.Validation_F1], np.mean(scores[r.Fraction], 0)) and r.Error is None


def test_does_not_depend_on_partitions(spark):
    cols = table(spark)[1]
    one, many = (newton.learning_curve(table(spark, parts=p)[0], cols, "y", "key", 3, (0.5, 1.0)).collect() for p in (1, 9))
    for a, b in zip(one, many):
        assert a.Training_Size == b.Training_Size and a.Training_F1 == pytest.approx(b.Training_F1) and a.Validation_F1 == pytest.approx(b.Validation_F1)


def test_odd_tables(spark):
    schema = "key long, x double, y int"
    # a third of all rows the same one, null keys, a missing feature, rows without a class, two classes that a line parts
    rows = [(1, 0.5, 0)] * 40 + [(None, float(k), int(k > 15)) for k in range(40)] + [(k, 2.0 * k, 1) for k in range(9, 40)] + [(7, None, 0), (8, 1.0, None)]
    got = newton.learning_curve(spark.createDataFrame(rows, schema), ["x"], "y", "key", 3, (0.3, 1.0)).collect()
    assert len(got) == 2 and all(r.Error is None and r.Validation_F1 > 0.9 for r in got)
    for some in ([], [(k, 1.0, 0) for k in range(10)]):
        got = newton.learning_curve(spark.createDataFrame(some, schema), ["x"], "y", "key", 3, (0.3, 1.0)).collect()
        assert len(got) == 2 and all(r.Training_F1 is None and r.Error == "3 of 3 folds have one class" for r in got)
