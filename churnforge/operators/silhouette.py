"""Euclidean silhouette of a whole table from quadtree moments, with a proven error bound.

The silhouette of a point needs its mean distance to every cluster. The points
of each cluster are summed up in a quadtree: count, centroid, second moments
and a box around the points of every cell. For a point at distance ``d`` from a cell's
centroid, with ``v`` the mean squared distance of the cell's points from it and ``r`` the largest,

* the mean distance to the cell's points is at least ``d`` and at most ``sqrt(d² + v)`` (both by Jensen's
  inequality), and
* for ``d > r`` it is ``d + (tr M − uᵀMu) / 2d`` (``M`` the covariance, ``u`` the direction) up to
  ``r·v / (3√3 (d − r)²)``, the largest third derivative of the distance along a line.

Sums of such intervals bound the mean distances, and so each point's silhouette, from both sides: it
grows with the distance to the nearest other cluster and falls with that to its own. The
mean of all points is known to half the width of the mean interval. Far cells are taken whole, near ones are
opened, and heavy cells are divided further until the bound meets the tolerance; a cell of
equal points is exact. No pairs of points are formed and no point is left out.

One job makes the cells of a level and one job scores all points. The cells, whose number depends on the tolerance
and the shape of the data but not on the number of rows, go to every task.

Defined results: rows without a label or with a missing or infinite coordinate do not count; a point alone in its
cluster has silhouette 0; the silhouette is null where there are fewer than two labels or no label has two points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.operators.stats import spread

BASE = 6          # levels of the first quadtree: at most 4**6 cells a label
DEEPER = 3        # levels added where a cell is divided further
TARGETS = 4       # points are scored in groups of the cells of this level
MOST_CELLS = 1 << 20
CHUNK = 1 << 16   # point-cell distances held at a time; half a MB an array, so that they stay in a core's cache
GROUP_ROWS = 200_000
ROUNDS = 8
FIELDS = ("label", "ix", "iy", "n", "cx", "cy", "xx", "xy", "yy", "lox", "hix", "loy", "hiy", "kid", "kids")


@dataclass
class Frame:
    """The square that holds all points."""
    x0: float
    y0: float
    side: float

    def cell(self, c: str, low: float, level: int) -> F.Column:
        scale = 2 ** level
        at = F.floor((F.col(c) - F.lit(low)) / F.lit(self.side) * F.lit(float(scale)))
        return F.greatest(F.lit(0), F.least(at, F.lit(scale - 1))).cast("bigint")


def cells_of(points: DataFrame, frame: Frame, level: int) -> dict[str, np.ndarray]:
    """Moments of all occupied cells of a level, from one aggregate; sums are taken about the cell's corner."""
    width = frame.side / 2 ** level
    u = F.col("x") - (F.lit(frame.x0) + F.col("ix") * F.lit(width))
    v = F.col("y") - (F.lit(frame.y0) + F.col("iy") * F.lit(width))
    placed = points.withColumn("ix", frame.cell("x", frame.x0, level)).withColumn("iy", frame.cell("y", frame.y0, level))
    rows = placed.groupBy("label", "ix", "iy").agg(
        F.count("*").alias("n"), F.sum(u).alias("su"), F.sum(v).alias("sv"), F.sum(u * u).alias("suu"), F.sum(u * v).alias("suv"), F.sum(v * v).alias("svv"),
        F.min("x").alias("lox"), F.max("x").alias("hix"), F.min("y").alias("loy"), F.max("y").alias("hiy")).limit(MOST_CELLS + 1).toArrow()
    if rows.num_rows > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells: the labels do not form clusters in the plane")
    c = {f: rows[f].to_numpy() for f in rows.column_names}
    n = c["n"].astype(float)
    mu, mv = c["su"] / n, c["sv"] / n
    one = (c["lox"] == c["hix"]) & (c["loy"] == c["hiy"])  # equal points: no spread, whatever the rounding
    centred = lambda s, a, b: np.where(one, 0.0, s - n * a * b)
    return {"label": c["label"], "ix": c["ix"], "iy": c["iy"], "n": n,
            "cx": np.where(one, c["lox"], np.clip(frame.x0 + c["ix"] * width + mu, c["lox"], c["hix"])),
            "cy": np.where(one, c["loy"], np.clip(frame.y0 + c["iy"] * width + mv, c["loy"], c["hiy"])),
            "xx": np.maximum(centred(c["suu"], mu, mu), 0), "xy": centred(c["suv"], mu, mv), "yy": np.maximum(centred(c["svv"], mv, mv), 0),
            "lox": c["lox"], "hix": c["hix"], "loy": c["loy"], "hiy": c["hiy"], "kid": np.zeros(len(n), np.int64), "kids": np.zeros(len(n), np.int64)}


def parents_of(cells: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(cells in the order of their parents, parents); ``kid`` and ``kids`` of a parent are its run of cells."""
    px, py = cells["ix"] >> 1, cells["iy"] >> 1
    order = np.lexsort((py, px, cells["label"]))
    cells, px, py = {f: a[order] for f, a in cells.items()}, px[order], py[order]
    lab = cells["label"]
    first = np.flatnonzero(np.r_[True, (lab[1:] != lab[:-1]) | (px[1:] != px[:-1]) | (py[1:] != py[:-1])])
    count = np.diff(np.r_[first, len(lab)])
    add = lambda a: np.add.reduceat(a, first)
    n = add(cells["n"])
    cx, cy = add(cells["n"] * cells["cx"]) / n, add(cells["n"] * cells["cy"]) / n
    dx, dy = cells["cx"] - np.repeat(cx, count), cells["cy"] - np.repeat(cy, count)
    return cells, {
        "label": lab[first], "ix": px[first], "iy": py[first], "n": n, "cx": cx, "cy": cy, "kid": first, "kids": count,
        "xx": add(cells["xx"] + cells["n"] * dx * dx), "xy": add(cells["xy"] + cells["n"] * dx * dy), "yy": add(cells["yy"] + cells["n"] * dy * dy),
        "lox": np.minimum.reduceat(cells["lox"], first), "hix": np.maximum.reduceat(cells["hix"], first),
        "loy": np.minimum.reduceat(cells["loy"], first), "hiy": np.maximum.reduceat(cells["hiy"], first)}


def levels_over(cells: dict[str, np.ndarray], up: int) -> list[dict[str, np.ndarray]]:
    """The cells of ``up`` levels above and the cells themselves, the highest level first."""
    out = []
    for _ in range(up):
        cells, above = parents_of(cells)
        out.append(cells)
        cells = above
    return [cells, *reversed(out)]


class Tree:
    """Cells of all labels with their children, roots first by label."""

    def __init__(self, base: dict[str, np.ndarray], level: int):
        levels = levels_over(base, level)
        self.labels = levels[0]["label"]
        self.at = {f: np.empty(0, a.dtype) for f, a in levels[0].items()}
        self.level = np.empty(0, np.int64)
        for k, cells in enumerate(levels):
            self._append(cells, k)
        self._derive()

    def _append(self, cells: dict[str, np.ndarray], level: int) -> int:
        """Put one level's cells at the end; the children of the level stand right behind it."""
        start, size = len(self.level), len(cells["n"])
        self.at = {f: np.concatenate([self.at[f], cells[f] + (start + size if f == "kid" else 0)]) for f in FIELDS}
        self.level = np.r_[self.level, np.full(size, level)]
        return start

    def _derive(self) -> None:
        a = self.at
        self.spread = a["xx"] + a["yy"]
        self.r = np.hypot(np.maximum(a["cx"] - a["lox"], a["hix"] - a["cx"]), np.maximum(a["cy"] - a["loy"], a["hiy"] - a["cy"]))
        self.number = np.searchsorted(self.labels, a["label"])
        self.of_label = a["n"][:len(self.labels)]
        n, w = self.of_label.sum(), self.of_label
        cx, cy = (w * a["cx"][:len(w)]).sum() / n, (w * a["cy"][:len(w)]).sum() / n
        self.scale = math.sqrt((self.spread[:len(w)] + w * ((a["cx"][:len(w)] - cx) ** 2 + (a["cy"][:len(w)] - cy) ** 2)).sum() / n)

    def weight(self) -> np.ndarray:
        """The most that a cell can add to the error of a mean distance."""
        return np.sqrt(self.at["n"] * self.spread) / self.of_label[self.number]

    def heavy(self, light: float) -> np.ndarray:
        """Cells without children that weigh more than ``light``."""
        return np.flatnonzero((self.at["kids"] == 0) & (self.weight() > light * self.scale))

    def divide(self, which: np.ndarray, finer: dict[str, np.ndarray], level: int) -> None:
        """Put the cells of a deeper level under the cells ``which``, with the levels between."""
        for k in np.unique(self.level[which]).tolist():
            top = which[self.level[which] == k]
            holders, *below = levels_over(self._under(finer, top, level - k), level - k)
            slot = {key: i for i, key in zip(top.tolist(), self._keys(self.at, top))}
            at = np.array([slot[key] for key in self._keys(holders)], np.int64)
            start = self._append(below[0], k + 1)
            self.at["kid"][at], self.at["kids"][at] = holders["kid"] + start, holders["kids"]
            for depth, cells in enumerate(below[1:], 2):
                self._append(cells, k + depth)
        self._derive()

    @staticmethod
    def _keys(cells: dict[str, np.ndarray], which=slice(None)) -> list[tuple[int, int, int]]:
        return list(zip(*(cells[f][which].tolist() for f in ("label", "ix", "iy"))))

    def _under(self, finer: dict[str, np.ndarray], top: np.ndarray, depth: int) -> dict[str, np.ndarray]:
        keys = set(self._keys(self.at, top))
        mine = np.array([key in keys for key in zip(finer["label"].tolist(), (finer["ix"] >> depth).tolist(), (finer["iy"] >> depth).tolist())], bool)
        return {f: a[mine] for f, a in finer.items()}

    def seen_from(self, box: tuple[float, float, float, float], present: np.ndarray, light: float, far: float) -> np.ndarray:
        """Cells that stand for all points of the clusters that matter to a box, by label."""
        lox, hix, loy, hiy = box
        a = self.at
        near = lambda k: np.hypot(np.maximum(np.maximum(lox - a["cx"][k], a["cx"][k] - hix), 0), np.maximum(np.maximum(loy - a["cy"][k], a["cy"][k] - hiy), 0))
        roots = np.arange(len(self.labels))
        # a cluster matters if it can be the nearest or the second nearest one for a point of the box
        most = np.hypot(np.maximum(np.abs(lox - a["cx"][roots]), np.abs(hix - a["cx"][roots])), np.maximum(np.abs(loy - a["cy"][roots]), np.abs(hiy - a["cy"][roots])))
        most = np.sqrt(most ** 2 + self.spread[roots] / a["n"][roots])
        bound = np.partition(most, 1)[1]
        keep = near(roots) <= bound
        keep[present] = True
        front, out = roots[keep], []
        weight = self.weight()
        while len(front):
            d = near(front) - self.r[front]
            v = self.spread[front] / a["n"][front]
            with np.errstate(divide="ignore", invalid="ignore"):
                good = (d > 0) & (self.r[front] * v / (math.sqrt(27) * d * d) <= far * self.scale)
            whole = good | (weight[front] <= light * self.scale) | (a["kids"][front] == 0)
            out.append(front[whole])
            front = front[~whole]
            count = a["kids"][front]
            front = np.repeat(a["kid"][front] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        out = np.concatenate(out)
        return out[np.argsort(self.number[out], kind="stable")]

    def score(self, x: np.ndarray, y: np.ndarray, label: np.ndarray, light: float, far: float) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) silhouette of points that lie together; ``label`` are numbers of labels."""
        cells = self.seen_from((x.min(), x.max(), y.min(), y.max()), np.unique(label), light, far)
        a, number = self.at, self.number[cells]
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        present = number[first]
        n, v, r = a["n"][cells], self.spread[cells] / a["n"][cells], self.r[cells]
        xx, xy, yy = (a[f][cells] / n for f in ("xx", "xy", "yy"))
        least, greatest = np.empty(len(x)), np.empty(len(x))
        step = max(1, CHUNK // len(cells))
        for s in range(0, len(x), step):
            dx, dy = x[s:s + step, None] - a["cx"][cells], y[s:s + step, None] - a["cy"][cells]
            d2 = dx * dx + dy * dy
            d = np.sqrt(d2)
            low, high = d, np.sqrt(d2 + v)
            with np.errstate(divide="ignore", invalid="ignore"):
                about = d + (v - (xx * dx * dx + 2 * xy * dx * dy + yy * dy * dy) / d2) / (2 * d)
                error = np.where(d > r, r * v / (math.sqrt(27) * (d - r) ** 2), np.inf)
                some = np.isfinite(error)
                low, high = np.where(some, np.maximum(low, about - error), low), np.where(some, np.minimum(high, about + error), high)
            low, high = np.add.reduceat(low * n, first, axis=1), np.add.reduceat(high * n, first, axis=1)
            own = np.searchsorted(present, label[s:s + step])
            rows = np.arange(len(own))
            size = self.of_label[label[s:s + step]]
            with np.errstate(divide="ignore", invalid="ignore"):
                a_low, a_high = low[rows, own] / (size - 1), high[rows, own] / (size - 1)
            low, high = low / self.of_label[present], high / self.of_label[present]
            low[rows, own] = high[rows, own] = np.inf
            b_low, b_high = low.min(axis=1), high.min(axis=1)
            least[s:s + step] = np.where(size > 1, _silhouette(a_high, b_low), 0.0)
            greatest[s:s + step] = np.where(size > 1, _silhouette(a_low, b_high), 0.0)
        return least, np.maximum(greatest, least)


def _silhouette(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(top > 0, (b - a) / top, 0.0)


def _scores(tree: Tree, frame: Frame, light: float, far: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows, n, low, high = 0, 0, 0.0, 0.0

        def flush() -> tuple[int, float, float]:
            x, y, label = (np.concatenate(c) for c in zip(*held))
            label = np.searchsorted(tree.labels, label)
            scale = 2 ** TARGETS / frame.side
            at = np.floor((x - frame.x0) * scale).astype(np.int64) * 4 ** TARGETS + np.floor((y - frame.y0) * scale).astype(np.int64)
            order = np.argsort(at, kind="stable")
            sums = np.zeros(2)
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                sums += [s.sum() for s in tree.score(x[part], y[part], label[part], light, far)]
            return len(x), *sums

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows >= GROUP_ROWS:
                k, a, b = flush()
                n, low, high, held, rows = n + k, low + a, high + b, [], 0
        if rows:
            k, a, b = flush()
            n, low, high = n + k, low + a, high + b
        yield pa.RecordBatch.from_pydict({"n": [n], "low": [low], "high": [high]})

    return run


def silhouette_euclidean(df: DataFrame, cols: list[str], label: str, tolerance: float = 1e-4) -> DataFrame:
    """One row: Silhouette_Euclidean of the whole table and Error_Bound, the proven distance to the exact value.

    The bound is at most ``tolerance`` unless ``ROUNDS`` divisions or ``MOST_CELLS`` cells do not reach it.
    """
    if len(cols) != 2:
        raise ValueError("the Euclidean silhouette is built for points of the plane")
    spark = df.sparkSession
    x, y = (F.col(f"`{c}`").cast("double") for c in cols)
    named = df.select(x.alias("x"), y.alias("y"), F.col(f"`{label}`").cast("string").alias("_l"))
    big = F.lit(1.7976931348623157e308)
    sound = named.where(F.col("_l").isNotNull() & (F.abs("x") <= big) & (F.abs("y") <= big))
    points = spread(sound.select("x", "y", F.xxhash64("_l").alias("label")).checkpoint(eager=True))
    box = points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    schema = "Silhouette_Euclidean double, Error_Bound double"
    if not box["n"]:
        return spark.createDataFrame([(None, None)], schema)
    frame = Frame(box["x0"], box["y0"], max(box["x1"] - box["x0"], box["y1"] - box["y0"]) * (1 + 1e-9) or 1.0)
    tree = Tree(cells_of(points, frame, BASE), BASE)
    if len(tree.labels) < 2 or len(tree.labels) >= box["n"]:
        return spark.createDataFrame([(None, None)], schema)
    light, far, level = 0.3 * tolerance, tolerance, BASE  # enough in most cases; both fall until the bound holds
    for turn in range(ROUNDS):
        while len(which := tree.heavy(light)) and level < 50 and len(tree.level) < MOST_CELLS:
            level += DEEPER
            tree.divide(which, _finer(points, tree, which, frame, level), level)
        low_high = points.mapInArrow(_scores(tree, frame, light, far), "n long, low double, high double").agg(*[F.sum(c).alias(c) for c in ("n", "low", "high")]).first()
        value, bound = (low_high["low"] + low_high["high"]) / 2 / low_high["n"], (low_high["high"] - low_high["low"]) / 2 / low_high["n"]
        if bound <= tolerance or len(tree.level) >= MOST_CELLS:
            break
        light, far = light / 4, far / 3
    return spark.createDataFrame([(value, bound)], schema)


def _finer(points: DataFrame, tree: Tree, which: np.ndarray, frame: Frame, level: int) -> dict[str, np.ndarray]:
    """Cells of a deeper level under the cells ``which`` (at most MOST_CELLS, sent as a table)."""
    spark, parts = points.sparkSession, []
    for k in np.unique(tree.level[which]):
        own = which[tree.level[which] == k]
        listed = spark.createDataFrame(pa.table({"label": tree.at["label"][own], "px": tree.at["ix"][own], "py": tree.at["iy"][own]}))
        placed = points.withColumn("px", F.shiftright(frame.cell("x", frame.x0, level), level - int(k))) \
            .withColumn("py", F.shiftright(frame.cell("y", frame.y0, level), level - int(k)))
        parts.append(cells_of(placed.join(F.broadcast(listed), ["label", "px", "py"], "left_semi").select("x", "y", "label"), frame, level))
    return {f: np.concatenate([p[f] for p in parts]) for f in FIELDS}
