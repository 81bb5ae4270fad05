"""Learning curves: the logistic fits of all folds and train sizes in one Newton loop.

Rows are ranked within their class by a hash (a distributed running sum). Blocks of ranks are the folds, so
every fold holds the same share of each class to within a row, and a train size takes the first ranks of a class
outside the fold, so smaller sizes are inside larger ones. A row knows its runs from class and rank
alone: no copy of the table is made for a run.

A pass adds, for every run that still moves, loss, gradient and the upper triangle of the curvature over the run's rows;
a task leaves one number for each of them. The driver holds (folds x sizes) x (features + 1)^2 / 2 numbers. The objective is
half the squared coefficients (not the intercept) plus the balanced-weighted log loss. A step that makes it
worse is halved. A last pass counts the hits of all runs on their train rows and their fold.

Defined results: a run whose train rows are of one class is not fitted; missing features count as 0; rows
without a class are left out; an empty table gives every size without figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.operators.stats import running_sum
from churnforge.session import checkpoint_dir

RANK, CLASS = "_rank", "_class"
MOST_STEPS = 50
STILL = 1e-9  # Newton decrement, relative to the objective, at which a run is done
BATCH = 4096  # rows that are multiplied at once


@dataclass
class Runs:
    """All (fold, size) runs; class counts say which ranks belong to each."""
    count: dict[int, int]
    folds: int
    sizes: tuple
    pairs: list[tuple[int, float]] = field(init=False)

    def __post_init__(self):
        self.pairs = [(f, s) for f in range(self.folds) for s in self.sizes]

    def block(self, y: int, fold: int) -> tuple[int, int]:
        """First rank, and the one after the last, of a fold within a class."""
        n = self.count.get(y, 0)
        return fold * n // self.folds, (fold + 1) * n // self.folds

    def taken(self, y: int, run: int) -> int:
        """Train rows of a class in a run."""
        fold, size = self.pairs[run]
        a, b = self.block(y, fold)
        return int(round(size * (self.count.get(y, 0) - (b - a))))

    def weight(self, y: int, run: int) -> float:
        own = self.taken(y, run)
        return (self.taken(0, run) + self.taken(1, run)) / (2 * own) if own else 0.0

    def fits(self, run: int) -> bool:
        return self.taken(0, run) > 0 and self.taken(1, run) > 0

    def sides(self, y: np.ndarray, rank: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(is a train row, is in the held-out fold) of rows by class and rank from 0."""
        fold = self.pairs[run][0]
        ends = np.array([[*self.block(c, fold), self.taken(c, run)] for c in (0, 1)])[y]
        a, b, most = ends.T
        held = (rank >= a) & (rank < b)
        place = np.where(rank >= b, rank - (b - a), rank)
        return ~held & (place < most), held


def ranked(df: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """(features, class, rank from 0 within the class), by a hash of key and row; written once."""
    checkpoint_dir(df.sparkSession)
    value = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(features)]
    # the last part tells equal rows apart, which are interchangeable
    order = F.struct(F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit(7)).alias("a"), F.xxhash64(*value).alias("b"), F.monotonically_increasing_id().alias("c"))
    rows = df.where(F.col(label).isin(0, 1)).select(*value, F.col(label).cast("int").alias(CLASS), order.alias("_order"), F.lit(1).cast("long").alias("one"))
    placed = running_sum(rows, "_order", ["one"], [CLASS])
    return placed.select(*[f"x{k}" for k in range(len(features))], CLASS, (F.col("cum_one") - 1).alias(RANK)).checkpoint()


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features and a 1, class, rank) of a few thousand rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            part = whole.slice(at, BATCH)
            x = np.column_stack([np.asarray(part.column(k)) for k in range(width)] + [np.ones(part.num_rows)])
            yield x, np.asarray(part.column(width)), np.asarray(part.column(width + 1))


def _slopes(runs: Runs, coefficients: dict[int, np.ndarray], width: int):
    """The task's function of a pass: (run, place, value) of loss, gradient and curvature."""
    upper = np.triu_indices(width + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {r: np.zeros(1 + width + 1 + len(upper[0])) for r in coefficients}
        for x, y, rank in _blocks(batches, width):
            for r, beta in coefficients.items():
                mine = runs.sides(y, rank, r)[0]
                xr, yr = x[mine], y[mine]
                w = np.array([runs.weight(0, r), runs.weight(1, r)])[yr]
                z = xr @ beta
                p = 0.5 * (1 + np.tanh(0.5 * z))
                curve = (xr * (w * p * (1 - p))[:, None]).T @ xr
                sums[r] += np.r_[w @ (np.logaddexp(0, z) - yr * z), xr.T @ (w * (p - yr)), curve[upper]]
        for r, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), r, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["run", "place", "value"])

    return add


def fit(rows: DataFrame, runs: Runs, width: int) -> dict[int, tuple[np.ndarray, int, bool]]:
    """run -> (coefficients with the intercept last, passes, converged) of every run with both classes."""
    ridge = np.r_[np.ones(width), 0.0]
    upper = np.triu_indices(width + 1)
    at = {r: np.zeros(width + 1) for r in range(len(runs.pairs)) if runs.fits(r)}
    last: dict[int, tuple[np.ndarray, float, np.ndarray]] = {}  # accepted place, its objective, step from it
    done: dict[int, tuple[np.ndarray, int, bool]] = {}
    for n in range(1, MOST_STEPS + 1):
        live = {r: b for r, b in at.items() if r not in done}
        if not live:
            break
        got = {r: np.zeros(1 + width + 1 + len(upper[0])) for r in live}
        found = rows.mapInArrow(_slopes(runs, live, width), "run int, place int, value double").groupBy("run", "place").agg(F.sum("value").alias("value"))
        for row in found.collect():
            got[row["run"]][row["place"]] = row["value"]
        for r, beta in live.items():
            objective = got[r][0] + 0.5 * ridge @ beta ** 2
            if r in last and objective > last[r][1] * (1 + 1e-12):
                place, best, step = last[r]
                last[r] = place, best, step / 2
                at[r] = place + step / 2
                continue
            gradient = got[r][1:width + 2] + ridge * beta
            curve = np.zeros((width + 1, width + 1))
            curve[upper] = got[r][width + 2:]
            curve = curve + np.triu(curve, 1).T + np.diag(ridge)
            step = -np.linalg.lstsq(curve, gradient, rcond=None)[0]
            if -gradient @ step <= STILL * max(objective, 1.0):
                done[r] = beta + step, n, True
            last[r] = beta, objective, step
            at[r] = beta + step
    return done | {r: (last[r][0], MOST_STEPS, False) for r in at if r not in done}


def _hits(runs: Runs, coefficients: dict[int, np.ndarray], width: int):
    """The task's function of the last pass: hits of every run on its train rows and its fold."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(r, side): np.zeros(3, np.int64) for r in coefficients for side in (0, 1)}
        for x, y, rank in _blocks(batches, width):
            for r, beta in coefficients.items():
                said = x @ beta > 0
                for side, mine in enumerate(runs.sides(y, rank, r)):
                    sums[r, side] += [(mine & said & (y == 1)).sum(), (mine & said & (y == 0)).sum(), (mine & ~said & (y == 1)).sum()]
        table = np.array([[r, side, *v] for (r, side), v in sums.items()], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(5)], names=["run", "side", "tp", "fp", "fn"])

    return count


def learning_curve(train: DataFrame, features: list[str], label: str, key: str, folds: int, sizes: tuple) -> DataFrame:
    """One row per train size: mean rows, train and validation F1 over the folds, an error text and the passes used."""
    spark, width = train.sparkSession, len(features)
    rows = ranked(train, features, label, key)
    runs = Runs({r[CLASS]: r["count"] for r in rows.groupBy(CLASS).count().collect()}, folds, tuple(sizes))
    fitted = fit(rows, runs, width)
    score = {}
    if fitted:
        hits = rows.mapInArrow(_hits(runs, {r: b for r, (b, _, _) in fitted.items()}, width), "run long, side long, tp long, fp long, fn long")
        for h in hits.groupBy("run", "side").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect():
            most = 2 * h["tp"] + h["fp"] + h["fn"]
            score[h["run"], h["side"]] = 2 * h["tp"] / most if most else 0.0
    out = [(float(s), f, runs.taken(0, r) + runs.taken(1, r), score.get((r, 0)), score.get((r, 1)),
            fitted[r][1] if r in fitted else None, fitted[r][2] if r in fitted else None) for r, (f, s) in enumerate(runs.pairs)]
    df = spark.createDataFrame(out, "Fraction double, fold int, n bigint, Training_F1 double, Validation_F1 double, passes int, ended boolean")
    failed, open_ = F.count_if(F.col("Training_F1").isNull()), F.count_if(~F.col("ended"))
    return (df.groupBy("Fraction")
            .agg(F.avg("n").alias("Training_Size"), F.avg("Training_F1").alias("Training_F1"), F.avg("Validation_F1").alias("Validation_F1"),
                 F.when(failed > 0, F.format_string("%d of %d folds have one class", failed, F.count(F.lit(1))))
                 .when(open_ > 0, F.format_string("%d of %d fits did not converge", open_, F.count(F.lit(1)))).alias("Error"),
                 F.max("passes").alias("Passes"))
            .orderBy("Fraction"))
