"""Grid DBSCAN equals brute-force DBSCAN (core set, noise set, core partition)."""

import numpy as np
import pytest

from brute import dbscan_brute
from conftest import SF_SMALL
from churnforge.operators import dbscan as DB
from churnforge.operators import segment as SG
from churnforge.sources import fixtures


def _check(spark, pdf_points, eps, ms):
    df = spark.createDataFrame(pdf_points)
    out = DB.dbscan(df, eps=eps, min_samples=ms).toPandas().sort_values("customerID").reset_index(drop=True)
    pts = pdf_points.sort_values("customerID").reset_index(drop=True)
    core, lab = dbscan_brute(pts[["PC1", "PC2"]].to_numpy(), eps, ms)
    assert (core == out.is_core.to_numpy()).all()
    assert ((lab == -1) == (out.DBSCAN_Cluster.to_numpy() == -1)).all()
    m = {}
    for a, b in zip(lab[core], out.DBSCAN_Cluster.to_numpy()[core]):
        assert m.setdefault(a, b) == b
    assert len(set(m.values())) == len(m)


def test_dbscan_on_pca_points(spark):
    fit = SG.segment(fixtures.subscribers(spark, SF_SMALL), n_init=1)
    _check(spark, fit.points.select("customerID", "PC1", "PC2").toPandas(), 0.2, 3)


def test_dbscan_sparse_random(spark):
    import pandas as pd
    rng = np.random.default_rng(11)
    P = np.vstack([rng.normal(0, 0.3, (150, 2)), rng.normal(3, 0.05, (60, 2)), rng.uniform(-4, 6, (90, 2))])
    P = np.vstack([P, P[:5]])  # exact duplicates
    pdf = pd.DataFrame({"customerID": [f"k{i:04d}" for i in range(len(P))], "PC1": P[:, 0], "PC2": P[:, 1]})
    _check(spark, pdf, 0.2, 3)
    _check(spark, pdf, 0.35, 5)


def _points(P):
    import pandas as pd
    return pd.DataFrame({"customerID": [f"k{i:05d}" for i in range(len(P))], "PC1": P[:, 0], "PC2": P[:, 1]})


def test_most_points_in_one_cell(spark, monkeypatch):
    """80 % of the points in one cell: sparse and border points beside it, a second dense cell just in and just out of reach."""
    monkeypatch.setattr(DB, "FEW", 4)
    rng = np.random.default_rng(3)
    side = 0.2 / np.sqrt(2)
    dense = rng.uniform(0.001, side - 0.001, (640, 2))
    ring = rng.uniform(-0.35, 0.5, (110, 2))
    for gap in (0.1999, 0.2001):
        beside = np.c_[dense[:, 0].max() + gap + rng.uniform(0, 0.02, 50), np.full(50, dense[np.argmax(dense[:, 0]), 1])]
        _check(spark, _points(np.vstack([dense, ring, beside])), 0.2, 3)


@pytest.mark.parametrize("few", [1, 64])
def test_two_dense_neighbours(spark, monkeypatch, few):
    """Two cells of many points whose facing sides are curved about the distance eps: only a few pairs link them, or none."""
    monkeypatch.setattr(DB, "FEW", few)
    rng = np.random.default_rng(8)
    angle = rng.uniform(-0.6, 0.6, 300)
    left = np.c_[0.05 * np.cos(angle), 0.05 * np.sin(angle)] - [0.05, 0.0] + 0.07
    for gap in (0.19999, 0.2, 0.20001):
        right = np.c_[-0.05 * np.cos(angle), 0.05 * np.sin(angle)] + [0.05 + gap, 0.0] + 0.07
        _check(spark, _points(np.vstack([left, right])), 0.2, 4)


def test_rows_without_a_place_are_noise(spark):
    rows = [("a", 0.0, 0.0), ("b", 0.0, 0.1), ("c", 0.1, 0.0), ("d", None, 0.0), ("e", 0.0, None), ("f", float("nan"), 0.0), ("g", float("inf"), 1.0), ("c", 0.1, 0.0)]
    out = DB.dbscan(spark.createDataFrame(rows, "customerID string, PC1 double, PC2 double")).collect()
    assert sorted((r.customerID, r.DBSCAN_Cluster, r.is_core) for r in out) == sorted(
        (k, 0, True) if k in "abc" else (k, -1, False) for k, _, _ in rows)
    assert DB.dbscan(spark.createDataFrame(rows[3:5], "customerID string, PC1 double, PC2 double")).count() == 2

