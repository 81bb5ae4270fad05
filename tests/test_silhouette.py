"""Euclidean silhouette: within its own bound of all pairs, on any shape and any number of labels."""

import numpy as np
import pandas as pd
import pytest

from churnforge.operators import silhouette as SIL


def brute(P, labels):
    d = np.sqrt(((P[:, None, :] - P[None, :, :]) ** 2).sum(-1))
    uniq, out = np.unique(labels), np.zeros(len(P))
    for i in range(len(P)):
        own = labels == labels[i]
        if own.sum() > 1:
            a = d[i, own].sum() / (own.sum() - 1)
            b = min(d[i, labels == u].mean() for u in uniq if u != labels[i])
            out[i] = 0.0 if max(a, b) == 0 else (b - a) / max(a, b)
    return out


def shapes():
    rng = np.random.default_rng(5)
    blobs = np.vstack([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 1, 900), ((4, 1), 0.3, 700), ((2, 5), 2, 400))])
    yield "blobs", blobs, np.repeat([0, 1, 2], [900, 700, 400])
    yield "mixed labels", blobs, rng.integers(0, 4, 2000)
    grid = rng.integers(0, 9, (2000, 2)).astype(float)
    yield "equal points", grid, (grid[:, 0] > 4).astype(int)
    hot = np.vstack([np.full((1500, 2), 3.0), rng.normal(0, 1e-3, (300, 2)), rng.normal(50, 5, (200, 2))])
    yield "one hot place", hot, np.r_[np.zeros(1500), np.ones(300), np.full(200, -1)].astype(int)
    many = rng.uniform(-5, 5, (2000, 2))
    yield "many labels", many, (np.floor(many[:, 0] * 2) * 100 + np.floor(many[:, 1] * 2)).astype(int)
    yield "one alone", np.vstack([blobs[:500], [[9, 9]]]), np.r_[np.zeros(250), np.ones(250), 2].astype(int)
    yield "a line", np.c_[np.arange(300.0), np.zeros(300)], np.repeat([0, 1], 150)


@pytest.mark.parametrize("name, P, labels", list(shapes()), ids=[s[0] for s in shapes()])
def test_within_the_bound(spark, name, P, labels):
    df = spark.createDataFrame(pd.DataFrame({"x": P[:, 0], "y": P[:, 1], "l": labels})).repartition(3)
    want = brute(P, labels).mean()
    for tolerance in (1e-2, 1e-4):
        got = SIL.silhouette_euclidean(df, ["x", "y"], "l", tolerance).first()
        assert got.Error_Bound <= tolerance and abs(got.Silhouette_Euclidean - want) <= got.Error_Bound + 1e-9


def test_every_point_lies_in_its_interval(spark):
    for _, P, labels in shapes():
        df = spark.createDataFrame(pd.DataFrame({"x": P[:, 0], "y": P[:, 1], "label": labels.astype(np.int64)}))
        side = float(np.ptp(P, axis=0).max()) * (1 + 1e-9)
        frame = SIL.Frame(float(P[:, 0].min()), float(P[:, 1].min()), side)
        tree = SIL.Tree(SIL.cells_of(df, frame, 4), 4)
        which = tree.heavy(1e-3)
        if len(which):
            tree.divide(which, SIL._finer(df, tree, which, frame, 7), 7)
        low, high = tree.score(P[:, 0], P[:, 1], np.searchsorted(tree.labels, labels), 1e-3, 1e-3)
        want = brute(P, labels)
        assert (low <= want + 1e-9).all() and (want <= high + 1e-9).all()


def test_odd_tables(spark):
    schema = "x double, y double, l string"
    undefined = [[], [(1.0, 1.0, "a")], [(1.0, 1.0, "a"), (2.0, 1.0, "b")], [(1.0, 1.0, "a"), (2.0, 2.0, "a")], [(None, 1.0, "a"), (1.0, 1.0, None)]]
    for rows in undefined:
        assert SIL.silhouette_euclidean(spark.createDataFrame(rows, schema), ["x", "y"], "l").first().Silhouette_Euclidean is None
    same = [(1.0, 1.0, "a")] * 3 + [(1.0, 1.0, "b")] * 3
    assert SIL.silhouette_euclidean(spark.createDataFrame(same, schema), ["x", "y"], "l").first().Silhouette_Euclidean == 0.0
    rows = [(0.0, 0.0, "a"), (0.0, 1.0, "a"), (5.0, 0.0, "b"), (5.0, 1.0, "b")]
    odd = [(None, 1.0, "a"), (float("nan"), 0.0, "a"), (1.0, float("inf"), "b"), (1.0, 1.0, None)]
    clean, dirty = (SIL.silhouette_euclidean(spark.createDataFrame(r, schema), ["x", "y"], "l").first() for r in (rows, rows + odd))
    assert clean == dirty
    with pytest.raises(ValueError):
        SIL.silhouette_euclidean(spark.createDataFrame(rows, schema), ["x"], "l")


def test_distances_held_at_a_time_fit_a_cache_and_change_nothing(spark, monkeypatch):
    assert SIL.CHUNK * 8 <= 1 << 20
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=3000), "y": rng.normal(size=3000), "l": rng.integers(0, 3, 3000)})).repartition(2)
    small = SIL.silhouette_euclidean(df, ["x", "y"], "l").first()
    monkeypatch.setattr(SIL, "CHUNK", 1 << 20)
    large = SIL.silhouette_euclidean(df, ["x", "y"], "l").first()
    assert abs(small[0] - large[0]) < 1e-12 and abs(small[1] - large[1]) < 1e-12
