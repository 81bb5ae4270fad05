"""Numeric checks of the fitted models and segmentation against NumPy."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from churnforge.operators import features as FE
from churnforge.operators import models as M
from churnforge.operators import segment as SG
from churnforge.sources import fixtures


def _newton_lr(X, y, w, iters=50):
    """argmin ½‖β‖² + Σ wᵢ·logloss (intercept unpenalised) — the reference objective with C = 1."""
    Xa = np.hstack([X, np.ones((len(X), 1))])
    b = np.zeros(Xa.shape[1])
    R = np.eye(Xa.shape[1])
    R[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xa @ b))
        g = Xa.T @ (w * (p - y)) + R @ b
        H = (Xa * (w * p * (1 - p))[:, None]).T @ Xa + R
        b -= np.linalg.solve(H, g)
    return b


def test_balanced_lr_matches_reference_objective(spark):
    data = M.prepare_training(fixtures.subscribers(spark, SF_SMALL))
    model, _ = M.fit_model(data, M.model_specs(data.n_train)[0])
    lr = model.stages[-1]
    pdf = data.train.select(*data.feature_columns, "Churn", "weight").toPandas()
    b = _newton_lr(pdf[data.feature_columns].to_numpy(float), pdf["Churn"].to_numpy(float), pdf["weight"].to_numpy(float))
    assert np.allclose(lr.coefficients.toArray(), b[:-1], atol=1e-5)
    assert abs(lr.intercept - b[-1]) < 1e-5


def test_weights_balanced(spark):
    data = M.prepare_training(fixtures.subscribers(spark, SF_SMALL))
    w = data.train.groupBy("Churn").agg(F.sum("weight").alias("s"), F.count("*").alias("n")).collect()
    assert abs(sum(r.s for r in w) - data.n_train) < 1e-6
    assert abs(w[0].s - w[1].s) < 1e-6


def test_pca_and_kmeans_fixed_point(spark):
    fit = SG.segment(fixtures.subscribers(spark, SF_SMALL), n_init=3)
    feats, _, cols = FE.segment_features(fixtures.subscribers(spark, SF_SMALL))
    X = feats.select(cols).toPandas().to_numpy(float)
    sd = X.std(0)
    Xs = (X - X.mean(0)) / np.where(sd == 0, 1, sd)
    w, v = np.linalg.eigh(np.cov(Xs, rowvar=False))
    v = v[:, ::-1][:, :2].T
    for j in range(2):
        if v[j, np.argmax(np.abs(v[j]))] < 0:
            v[j] = -v[j]
    assert np.abs(v - fit.pca.components).max() < 1e-8
    pts = fit.points.toPandas()
    P = pts[["PC1", "PC2"]].to_numpy()
    c = fit.kmeans.centres
    lab = np.argmin(((P[:, None] - c[None]) ** 2).sum(-1), 1)
    assert (lab == pts["Cluster"].to_numpy()).all()
    for j in range(len(c)):
        assert np.allclose(P[lab == j].mean(0), c[j], atol=1e-6)


def test_squared_silhouette_matches_brute(spark):
    from brute import silhouette_sq
    fit = SG.segment(fixtures.subscribers(spark, SF_SMALL), n_init=2)
    pts = fit.points.toPandas()
    got = SG.silhouette_squared(fit.points, ["PC1", "PC2"], "Cluster").first()[0]
    want = silhouette_sq(pts[["PC1", "PC2"]].to_numpy(), pts["Cluster"].to_numpy())
    assert abs(got - want) < 1e-6
