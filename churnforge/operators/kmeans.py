"""K-means: any number of starts and cluster counts, all advanced by the same passes over the data.

A pass compares every point with the centres of all runs that still move, as one matrix, and adds up count,
coordinates and squared distance for each run and centre inside the task; a partial aggregate adds
the tasks. Only those sums, one row per run and centre, reach the driver. A run leaves the passes once its
centres move by no more than ``tol``. Nothing is kept in executor storage.

First centres come from greedy k-means++ on a sample of at most ``SAMPLE`` rows with the smallest hashes, one
seed for each run; all later steps read every row.

Defined results: rows with a missing or infinite coordinate do not take part; a centre that loses all its points stays
where it is; fewer distinct points than centres leave some centres without points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.operators.stats import spread

SAMPLE = 10_000
CHUNK = 1 << 21  # point-centre distances held at a time


@dataclass
class Run:
    """One start: its centres, and after the fit their sizes and the sum of squared distances."""
    k: int
    seed: int
    centres: np.ndarray
    sizes: np.ndarray | None = None
    cost: float = 0.0
    steps: int = 0
    converged: bool = False


def plus_plus(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Greedy k-means++: of a few candidates drawn by squared distance the one that lowers the cost most."""
    centres = [sample[rng.integers(len(sample))]]
    nearest = ((sample - centres[0]) ** 2).sum(1)
    tries = 2 + int(np.log(k))
    for _ in range(k - 1):
        total = nearest.sum()
        drawn = rng.choice(len(sample), tries, p=nearest / total) if total > 0 else rng.integers(len(sample), size=tries)
        costs = [np.minimum(nearest, ((sample - sample[i]) ** 2).sum(1)) for i in drawn]
        best = int(np.argmin([c.sum() for c in costs]))
        centres.append(sample[drawn[best]])
        nearest = costs[best]
    return np.array(centres)


def nearest_sums(points: np.ndarray, runs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(counts, coordinate sums, squared distances) per centre for each run's centres; ties go to the first centre."""
    every = np.concatenate(runs)
    ends = np.cumsum([len(c) for c in runs])
    out = [(np.zeros(len(c), np.int64), np.zeros(c.shape), np.zeros(len(c))) for c in runs]
    step = max(1, CHUNK // len(every))
    for a in range(0, len(points), step):
        part = points[a:a + step]
        d2 = np.zeros((len(part), len(every)))
        for j in range(part.shape[1]):
            d2 += (part[:, j, None] - every[None, :, j]) ** 2
        for (n, s, c), e, own in zip(out, ends, runs):
            mine = d2[:, e - len(own):e]
            at = mine.argmin(1)
            n += np.bincount(at, minlength=len(own))
            for j in range(part.shape[1]):
                s[:, j] += np.bincount(at, part[:, j], len(own))
            c += np.bincount(at, mine[np.arange(len(at)), at], len(own))
    return out


def _pass(points: DataFrame, dims: int, runs: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Sizes, coordinate sums and cost of every run, from one scan."""
    numbers = list(runs)
    centres = [runs[i] for i in numbers]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = nearest_sums(np.column_stack([c.to_numpy() for c in batch.columns]), centres)
                total = got if total is None else [tuple(x + y for x, y in zip(a, b)) for a, b in zip(total, got)]
        if total is not None:
            rows = [(i, j, int(n[j]), *s[j].tolist(), float(c[j])) for i, (n, s, c) in zip(numbers, total) for j in range(len(n)) if n[j]]
            cols = list(zip(*rows))
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * (dims + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["run", "centre", "n", *[f"s{j}" for j in range(dims)], "cost"])

    sums = ["n", *[f"s{j}" for j in range(dims)], "cost"]
    schema = "run int, centre int, n long, " + ", ".join(f"s{j} double" for j in range(dims)) + ", cost double"
    out = {i: (np.zeros(len(c), np.int64), np.zeros(c.shape), np.zeros(len(c))) for i, c in runs.items()}
    for r in points.mapInArrow(task, schema).groupBy("run", "centre").agg(*[F.sum(c).alias(c) for c in sums]).collect():
        n, s, c = out[r["run"]]
        n[r["centre"]], s[r["centre"]], c[r["centre"]] = r["n"], [r[f"s{j}"] for j in range(dims)], r["cost"]
    return {i: (n, s, float(c.sum())) for i, (n, s, c) in out.items()}


def fit_runs(df: DataFrame, cols: list[str], starts: list[tuple[int, int]], max_iter: int = 300, tol: float = 1e-4) -> list[Run]:
    """Lloyd's steps for all ``starts`` (number of clusters, seed); no runs where no row has all coordinates."""
    most = F.lit(1.7976931348623157e308)
    named = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(cols)],
                      F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    sound = named
    for j in range(len(cols)):
        sound = sound.where(F.abs(f"x{j}") <= most)
    points = spread(sound.drop("h"))
    sample = np.array([tuple(r) for r in sound.orderBy("h", *points.columns).limit(SAMPLE).drop("h").collect()], float)
    if not len(sample):
        return []
    runs = [Run(k, seed, plus_plus(sample, k, np.random.default_rng(seed))) for k, seed in starts]
    for _ in range(max_iter):
        moving = {i: r.centres for i, r in enumerate(runs) if not r.converged}
        if not moving:
            break
        for i, (n, s, _) in _pass(points, len(cols), moving).items():
            run, some = runs[i], n > 0
            new = run.centres.copy()
            new[some] = s[some] / n[some, None]
            run.converged = bool((((new - run.centres) ** 2).sum(1) <= tol * tol).all())
            run.centres, run.steps = new, run.steps + 1
    for i, (n, _, cost) in _pass(points, len(cols), {i: r.centres for i, r in enumerate(runs)}).items():
        runs[i].sizes, runs[i].cost = n, cost
    return runs
