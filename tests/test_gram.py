"""Correlations of many columns by the Gram pass, against NumPy and the plain aggregate."""

import numpy as np
import pytest

from churnforge.operators import gram
from churnforge.operators import quality as Q


def plain(table: np.ndarray, i: int, j: int) -> float | None:
    x, y = table[:, i], table[:, j]
    both = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[both], y[both]
    if len(x) == 0 or np.isinf(x).any() or np.isinf(y).any() or (x == x[0]).all() or (y == y[0]).all():
        return None
    return float(np.corrcoef(x, y)[0, 1])


def random_table(rows: int, cols: int) -> np.ndarray:
    rng = np.random.default_rng(3)
    t = rng.normal(size=(rows, cols)) @ rng.normal(size=(cols, cols)) * rng.uniform(1e-3, 1e6, cols) + rng.normal(size=cols) * 1e7
    t[rng.random(t.shape) < 0.1] = np.nan
    t[:, 0] = 0.1  # constant
    t[:, 1] = np.nan  # missing everywhere
    t[5, 2] = np.inf
    t[: rows // 2, 3], t[rows // 2:, 4] = np.nan, np.nan  # no common row
    return t


def frame(spark, table: np.ndarray):
    names = [f"c{k}" if k != 6 else "odd name.6" for k in range(table.shape[1])]
    rows = [tuple(None if k % 2 and np.isnan(v) else float(v) for k, v in enumerate(r)) for r in table]  # nulls and NaN
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)), names


def check(spark, table, df, names):
    got = {(r.a, r.b): r.r for r in gram.correlations(df, names).collect()}
    assert list(got) and len(got) == len(names) * (len(names) - 1) // 2
    for j in range(len(names)):
        for i in range(j):
            want, r = plain(table, i, j), got[names[i], names[j]]
            assert (r is None) == (want is None), (i, j, r, want)
            assert want is None or abs(r - want) < 1e-9, (i, j, r, want)


@pytest.mark.parametrize("block", [512, 5])
def test_equals_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(gram, "BLOCK", block)
    table = random_table(400, 17)
    check(spark, table, *frame(spark, table))


def test_three_hundred_columns_in_one_pass(spark):
    table = random_table(300, 300)
    df, names = frame(spark, table)
    check(spark, table, df.repartition(4), names)


def test_pairs_far_from_the_centre_are_taken_again(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=50) * 1e-4, np.full(50, 1e9)]  # where y is present, x spreads little
    y = np.r_[x[:50] * 3 + rng.normal(size=50) * 1e-4, np.full(50, np.nan)]
    same = np.r_[np.full(50, 7.3), rng.normal(size=50) * 1e6]  # constant where y is present
    table = np.stack([x, y, same], 1)
    check(spark, table, *frame(spark, table))


def test_both_ways_agree(spark, monkeypatch):
    table = random_table(200, 8)[:, 3:]
    df, names = frame(spark, table)
    few = Q.pairwise_correlations(df, names)
    monkeypatch.setattr(Q, "FEW_COLUMNS", 2)
    many = Q.pairwise_correlations(df, names)
    assert [p[:2] for p in few] == [p[:2] for p in many]
    assert all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-9) for a, b in zip(few, many))


def test_empty_table(spark):
    df, names = frame(spark, random_table(20, 14))
    assert [p[2] for p in Q.pairwise_correlations(df.limit(0), names)] == [None] * 91
