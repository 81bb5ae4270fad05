"""K-means in shared passes: the steps of plain Lloyd iterations, fixed points, one scan for all starts."""

import numpy as np
import pandas as pd
import pytest

from churnforge.operators import kmeans as KM
from churnforge.operators import segment as SG


def table(spark, P):
    return spark.createDataFrame(pd.DataFrame({"customerID": [f"c{i}" for i in range(len(P))], "PC1": P[:, 0], "PC2": P[:, 1]})).repartition(5)


def lloyd(P, centres, tol=1e-4):
    while True:
        at = ((P[:, None, :] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([P[at == j].mean(0) if (at == j).any() else centres[j] for j in range(len(centres))])
        if (((new - centres) ** 2).sum(1) <= tol * tol).all():
            return new
        centres = new


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(2)
    return np.vstack([rng.normal(c, 0.6, (n, 2)) for c, n in (((0, 0), 500), ((5, 1), 300), ((1, 6), 200))])


def test_all_runs_are_plain_lloyd_runs(spark, blobs):
    starts = [(k, s) for k in (1, 2, 3, 5) for s in (1, 2)]
    runs = KM.fit_runs(table(spark, blobs), ["PC1", "PC2"], starts)
    # the sample holds all rows, in the order of their hashes; the first centres are read back from a fit of no steps
    begun = KM.fit_runs(table(spark, blobs), ["PC1", "PC2"], starts, max_iter=0)
    for run, start in zip(runs, begun):
        want = lloyd(blobs, start.centres)
        assert run.converged and np.allclose(run.centres, want, atol=1e-9)
        d2 = ((blobs[:, None, :] - want[None]) ** 2).sum(-1)
        assert np.isclose(run.cost, d2.min(1).sum()) and run.sizes.tolist() == np.bincount(d2.argmin(1), minlength=run.k).tolist()


def test_best_start_and_elbow(spark, blobs):
    fit = SG.fit_kmeans(table(spark, blobs), ["PC1", "PC2"], 3)
    assert np.allclose(fit.centres, [[0, 0], [5, 1], [1, 6]], atol=0.2)
    curve = {r.k: r.Inertia for r in SG.elbow(table(spark, blobs), ["PC1", "PC2"]).collect()}
    assert sorted(curve) == list(range(1, 10)) and all(curve[k] >= curve[k + 1] * 0.999 for k in range(1, 9))
    assert np.isclose(curve[1], len(blobs) * blobs.var(0).sum()) and np.isclose(curve[3], fit.cost)


def test_one_scan_per_round(spark, blobs, monkeypatch):
    calls = []
    plain = KM._pass
    monkeypatch.setattr(KM, "_pass", lambda p, d, runs: calls.append(len(runs)) or plain(p, d, runs))
    runs = KM.fit_runs(table(spark, blobs), ["PC1", "PC2"], [(3, s) for s in range(10)])
    assert len(calls) == max(r.steps for r in runs) + 1 and calls[0] == 10


def test_odd_points(spark):
    P = np.array([[0.0, 0.0]] * 40 + [[1.0, 0.0], [np.nan, 1.0], [np.inf, 0.0]])
    df = table(spark, P)
    run, = KM.fit_runs(df, ["PC1", "PC2"], [(4, 0)])
    assert run.sizes.sum() == 41 and run.cost == 0.0
    assert KM.fit_runs(df.limit(0), ["PC1", "PC2"], [(2, 0)]) == []
    with pytest.raises(ValueError):
        SG.fit_kmeans(df.limit(0), ["PC1", "PC2"])
