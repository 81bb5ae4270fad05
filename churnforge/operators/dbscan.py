"""Exact DBSCAN on 2-D points as Spark joins and aggregations.

Grid cells of side eps/√2 have a diagonal of eps, so all points of one cell are
mutual neighbours:

1. identical coordinates are collapsed (weight = multiplicity);
2. a cell holding ≥ min_samples points is all-core with no pair test; for a
   point of a sparse cell the surrounding cells are opened as a quadtree: a box inside
   the eps-disc counts in full, one out of reach not at all, and the others are opened
   while the count is still below min_samples;
3. two core cells are linked when some pair of their core points is within eps:
   first tested on 8 extreme points per cell (min/max of x, y, x+y, x−y); then the trees of
   both cells are descended together. A pair of boxes that lie within eps of one another at their farthest
   links the cells, one out of reach falls out, the others have one side opened, in turns;
   a cell pair is done with its first link;
4. connected components of the core-cell graph by min-label propagation with
   pointer jumping, checkpointed each round to the shared checkpoint folder;
5. a border point takes the smallest label among core cells that have a core
   point within eps (the reference's first-visited rule is order dependent);
   found by the same descent. Points with none are noise (-1), and so are points
   with a null, NaN or infinite coordinate.

A box is the bounds of its points, so a box of one place is decided exactly and every
descent ends. A box of at most ``FEW`` places is opened to them. Trees grow ``STEP`` levels at a time and only below cells that are still
open; no pairs of points are formed. Points meet labels by their cell, never by their
component; cells, whose number the extent of the data bounds and not its rows, meet components.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT = 4294967296  # cell id = cx · 2^32 + cy
STEP = 3            # levels that a descent goes down at a time: at most 8 × 8 boxes below a box
DEEPEST = 48        # at this level a box is a point up to the rounding of doubles
FEW = 64            # a box of so few places is opened to its places at once


def _cell_id(cx: str = "cx", cy: str = "cy") -> F.Column:
    return F.col(cx).cast("bigint") * F.lit(SHIFT) + F.col(cy).cast("bigint")


def _offsets(half: bool = False) -> Column:
    """Neighbour-cell offsets (dx, dy) within two cells, as a literal array of structs.

    Exploding it next to a point (or cell) emits its 25 (or 12) candidate
    neighbour cells; the candidates then meet the cell table by an equi-join.
    """
    rows = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]
    if half:
        rows = [(dx, dy) for dx, dy in rows if dx > 0 or (dx == 0 and dy > 0)]
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in rows])


def _with_offsets(df: DataFrame, half: bool = False) -> DataFrame:
    return df.select("*", F.inline(_offsets(half)))


def _d2(ax, ay, bx, by) -> F.Column:
    return F.pow(ax - bx, 2) + F.pow(ay - by, 2)


BOX = ("lox", "hix", "loy", "hiy")


def _near2(a: str = "", b: str = "o_") -> F.Column:
    """Least squared distance of two boxes; columns of the boxes begin with ``a`` and ``b``."""
    c = lambda p, n: F.col(p + n)
    dx = F.greatest(c(b, "lox") - c(a, "hix"), c(a, "lox") - c(b, "hix"), F.lit(0.0))
    dy = F.greatest(c(b, "loy") - c(a, "hiy"), c(a, "loy") - c(b, "hiy"), F.lit(0.0))
    return dx * dx + dy * dy


def _far2(a: str = "", b: str = "o_") -> F.Column:
    """Greatest squared distance of two boxes."""
    c = lambda p, n: F.col(p + n)
    dx = F.greatest(c(b, "hix") - c(a, "lox"), c(a, "hix") - c(b, "lox"))
    dy = F.greatest(c(b, "hiy") - c(a, "loy"), c(a, "hiy") - c(b, "loy"))
    return dx * dx + dy * dy


def _as_box(x: str = "x", y: str = "y") -> list[F.Column]:
    """A point as the box that holds it."""
    return [F.col(x).alias("lox"), F.col(x).alias("hix"), F.col(y).alias("loy"), F.col(y).alias("hiy")]


class _Trees:
    """Quadtrees of cells: the boxes of a level below the cells asked for."""

    def __init__(self, points: DataFrame, side: float):
        self.points, self.side = points, side

    def _at(self, c: str, base: str, level: int) -> F.Column:
        scale = 2 ** level
        inside = F.floor((F.col(c) - F.col(base) * F.lit(self.side)) / F.lit(self.side) * F.lit(float(scale)))
        return F.greatest(F.lit(0), F.least(inside, F.lit(scale - 1))).cast("bigint")

    def _below(self, pairs: DataFrame) -> DataFrame:
        """Points of the cells that pairs ask for."""
        return self.points.join(pairs.select(F.col("o_cell").alias("cell")).distinct(), "cell", "left_semi")

    def boxes(self, pairs: DataFrame, level: int) -> DataFrame:
        """o_cell, box numbers qx, qy of the level, their parents px, py, weight o_n, places o_m and bounds o_lox to o_hiy."""
        at = self._below(pairs).select("*", self._at("x", "cx", level).alias("qx"), self._at("y", "cy", level).alias("qy"))
        up = level - STEP
        return at.groupBy(F.col("cell").alias("o_cell"), "qx", "qy").agg(
            F.sum("w").alias("o_n"), F.count(F.lit(1)).alias("o_m"), F.min("x").alias("o_lox"), F.max("x").alias("o_hix"), F.min("y").alias("o_loy"),
            F.max("y").alias("o_hiy"), F.min(self._at("x", "cx", up)).alias("px"), F.min(self._at("y", "cy", up)).alias("py"))

    def places(self, pairs: DataFrame, up: int) -> DataFrame:
        """The same columns for single places, whose parents are boxes of the level ``up``."""
        none = F.lit(0).cast("bigint")
        return self._below(pairs).select(
            F.col("cell").alias("o_cell"), none.alias("qx"), none.alias("qy"), F.col("w").alias("o_n"), F.lit(1).cast("bigint").alias("o_m"),
            *[c.alias(f"o_{b}") for c, b in zip((F.col("x"), F.col("x"), F.col("y"), F.col("y")), BOX)],
            self._at("x", "cx", up).alias("px"), self._at("y", "cy", up).alias("py"))

    def open(self, pairs: DataFrame, level: int) -> DataFrame:
        """Pairs with the box (o_cell, px, py) replaced by each of its boxes of the next level.

        A box of at most ``FEW`` places is replaced by its places at once; a place stays as it is.
        """
        few = F.lit(True) if level >= DEEPEST else F.col("o_m") <= FEW
        bare = lambda p: p.drop("o_n", "o_m", *[f"o_{c}" for c in BOX])
        small, large = pairs.where((F.col("o_m") > 1) & few), pairs.where((F.col("o_m") > 1) & ~few)
        out = bare(small).join(self.places(small, level - STEP), ["o_cell", "px", "py"]).drop("px", "py")
        if level < DEEPEST:
            out = out.unionByName(bare(large).join(self.boxes(large, level), ["o_cell", "px", "py"]).drop("px", "py"))
        return _next(out).unionByName(pairs.where(F.col("o_m") == 1))


def _roots(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("px", F.lit(0).cast("bigint")).withColumn("py", F.lit(0).cast("bigint"))


def _next(pairs: DataFrame) -> DataFrame:
    return pairs.withColumnRenamed("qx", "px").withColumnRenamed("qy", "py")


def _count_near(points: DataFrame, cells: DataFrame, trees: _Trees, e2: float, enough: int) -> DataFrame:
    """(x, y) of the points that have at least ``enough`` weight within eps."""
    pairs = (_with_offsets(points).withColumn("ncx", F.col("cx") + F.col("dx")).withColumn("ncy", F.col("cy") + F.col("dy"))
             .select("x", "y", "ncx", "ncy", *_as_box()).join(cells, ["ncx", "ncy"]).drop("ncx", "ncy"))
    pairs = _roots(pairs).where(_near2() <= e2).checkpoint(eager=True)
    known, done, level = None, None, 0
    while True:
        # what is whole inside counts; a point with enough leaves the descent
        whole = pairs.where(_far2() <= e2).groupBy("x", "y").agg(F.sum("o_n").alias("k"))
        known = whole if known is None else known.unionByName(whole).groupBy("x", "y").agg(F.sum("k").alias("k"))
        known = known.checkpoint(eager=True)
        rich = known.where(F.col("k") >= enough).select("x", "y")
        open_ = pairs.where(_far2() > e2).join(rich, ["x", "y"], "left_anti")
        if open_.isEmpty():
            return rich
        level += STEP
        pairs = trees.open(open_, level).where(_near2() <= e2).checkpoint(eager=True)


def _any_near(pairs: DataFrame, keys: list[str], trees: _Trees, e2: float) -> DataFrame:
    """``keys`` of the points that have a point of the cell ``o_cell`` within eps."""
    pairs, found, level = _roots(pairs).where(_near2() <= e2).checkpoint(eager=True), [], 0
    while True:
        hit = pairs.where(_far2() <= e2).select(*keys).distinct().checkpoint(eager=True)
        found.append(hit)
        open_ = pairs.where(_far2() > e2).join(hit, keys, "left_anti")
        if open_.isEmpty():
            break
        level += STEP
        pairs = trees.open(open_, level).where(_near2() <= e2).checkpoint(eager=True)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _linked(pairs: DataFrame, trees: _Trees, e2: float) -> DataFrame:
    """(ca, cb) of the cell pairs with a pair of points within eps; both trees are opened, in turns."""
    keys, found, levels = ["ca", "cb"], [], [0, 0]
    own, other = ["cell", "ax", "ay", "n", "m", *BOX], ["o_cell", "px", "py", "o_n", "o_m", *[f"o_{c}" for c in BOX]]
    pairs = _roots(pairs).withColumn("ax", F.lit(0).cast("bigint")).withColumn("ay", F.lit(0).cast("bigint"))
    turn = 0
    while True:
        pairs = pairs.where(_near2() <= e2).checkpoint(eager=True)
        hit = pairs.where(_far2() <= e2).select(*keys).distinct().checkpoint(eager=True)
        found.append(hit)
        open_ = pairs.where(_far2() > e2).join(hit, keys, "left_anti")
        if open_.isEmpty():
            break
        levels[turn] += STEP
        pairs = trees.open(open_, levels[turn])
        # the sides change places, so that the next turn opens the other one
        pairs = pairs.select(*keys, *[F.col(b).alias(a) for a, b in zip(own, other)], *[F.col(a).alias(b) for a, b in zip(own, other)])
        turn = 1 - turn
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def dbscan(df: DataFrame, x: str = "PC1", y: str = "PC2", key: str = "customerID", eps: float = 0.2,
           min_samples: int = 3, label: str = "DBSCAN_Cluster") -> DataFrame:
    """(key, x, y, label, is_core) for every row; noise = -1, also where a coordinate is null, NaN or infinite."""
    e2 = eps * eps
    side = eps / math.sqrt(2.0)
    pts = df.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    finite = lambda c: F.abs(F.col(c)) <= F.lit(1.7976931348623157e308)
    uniq = (pts.where(finite("x") & finite("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"), F.min("_key").alias("_rep"))
            .withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
            .withColumn("cell", _cell_id()))
    uniq = uniq.checkpoint(eager=True)
    bounds = [F.min("x").alias("lox"), F.max("x").alias("hix"), F.min("y").alias("loy"), F.max("y").alias("hiy")]
    cells = uniq.groupBy("cell", "cx", "cy").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"), *bounds).checkpoint(eager=True)

    # --- 2. core points ------------------------------------------------------------------
    around = cells.select(F.col("cx").alias("ncx"), F.col("cy").alias("ncy"), F.col("cell").alias("o_cell"), F.col("n").alias("o_n"), F.col("m").alias("o_m"), *[F.col(c).alias(f"o_{c}") for c in BOX])
    sparse = uniq.join(cells.select("cell", "n").filter(F.col("n") < min_samples), "cell").drop("n")
    sparse_core = _count_near(sparse, around, _Trees(uniq, side), e2, min_samples).withColumn("_sc", F.lit(True))
    labelled = (uniq.join(cells.select("cell", "n"), "cell")
                .join(sparse_core, ["x", "y"], "left")
                .withColumn("is_core", (F.col("n") >= min_samples) | F.coalesce(F.col("_sc"), F.lit(False)))
                .drop("_sc", "n").checkpoint(eager=True))
    core = labelled.filter("is_core")
    trees = _Trees(core, side)

    # --- 3. links between core cells ---------------------------------------------------------
    pt = F.struct(F.col("x").alias("x"), F.col("y").alias("y"))
    ccell = core.groupBy("cell", "cx", "cy").agg(
        *bounds, F.min("_rep").alias("_rep"), F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"),
        F.array(F.min_by(pt, "x"), F.max_by(pt, "x"), F.min_by(pt, "y"), F.max_by(pt, "y"),
                F.min_by(pt, F.col("x") + F.col("y")), F.max_by(pt, F.col("x") + F.col("y")),
                F.min_by(pt, F.col("x") - F.col("y")), F.max_by(pt, F.col("x") - F.col("y"))).alias("reps"))
    ccell = ccell.checkpoint(eager=True)
    other = ccell.drop("_rep").select(*[F.col(c).alias("o_" + c) for c in ccell.columns if c != "_rep"])
    pairs = (_with_offsets(ccell.drop("_rep"), half=True)
             .join(other, (F.col("o_cx") == F.col("cx") + F.col("dx")) & (F.col("o_cy") == F.col("cy") + F.col("dy")))
             .where(_near2() <= e2)
             .select(F.col("cell").alias("ca"), F.col("o_cell").alias("cb"), "cell", "o_cell", "n", "m", "o_n", "o_m", *BOX, *[f"o_{c}" for c in BOX],
                     F.exists("reps", lambda p: F.exists("o_reps", lambda q: _d2(p["x"], p["y"], q["x"], q["y"]) <= e2)).alias("_hit")))
    pairs = pairs.checkpoint(eager=True)
    links = pairs.filter("_hit").select("ca", "cb").unionByName(_linked(pairs.filter(~F.col("_hit")).drop("_hit"), trees, e2))
    edges = links.select(F.col("ca").alias("src"), F.col("cb").alias("dst")).unionByName(
        links.select(F.col("cb").alias("src"), F.col("ca").alias("dst"))).checkpoint(eager=True)

    # --- 4. connected components --------------------------------------------------------------
    comp = connected_components(ccell.select(F.col("cell").alias("node")), edges).withColumnRenamed("node", "cell")
    of_cell = ccell.join(comp, "cell").checkpoint(eager=True)

    # --- 5. labels: core points by their cell, border points by the cell of least component within reach ----
    noncore = labelled.filter(~F.col("is_core"))
    reach = of_cell.select(F.col("cx").alias("ncx"), F.col("cy").alias("ncy"), F.col("cell").alias("o_cell"), "comp", F.col("n").alias("o_n"), F.col("m").alias("o_m"),
                           *[F.col(c).alias(f"o_{c}") for c in BOX])
    beside = (_with_offsets(noncore).withColumn("ncx", F.col("cx") + F.col("dx")).withColumn("ncy", F.col("cy") + F.col("dy"))
              .select("x", "y", "ncx", "ncy", "_rep", *_as_box()).join(reach, ["ncx", "ncy"]).drop("ncx", "ncy").withColumn("ncell", F.col("o_cell")))
    near = _any_near(beside, ["x", "y", "_rep", "ncell", "comp"], trees, e2)
    border = near.groupBy("x", "y").agg(F.min(F.struct("comp", F.col("ncell").alias("cell"))).alias("m"), F.min("_rep").alias("_rep")) \
        .select("x", "y", "_rep", "m.comp", F.col("m.cell").alias("label_cell")).checkpoint(eager=True)
    # number components 0.. by their smallest member key, with the distributed running sum
    from churnforge.operators.stats import running_sum
    firsts = (of_cell.select("comp", "_rep").unionByName(border.select("comp", "_rep")).groupBy("comp").agg(F.min("_rep").alias("_first"))
              .withColumn("_one", F.lit(1)))
    numbered = running_sum(firsts, "_first", ["_one"]).select("comp", (F.col("cum__one") - 1).alias("_id"))
    names = of_cell.select("cell", "comp").join(numbered, "comp").select(F.col("cell").alias("label_cell"), "_id")
    final = (labelled.join(border.select("x", "y", F.col("label_cell").alias("_b")), ["x", "y"], "left")
             .withColumn("label_cell", F.when(F.col("is_core"), F.col("cell")).otherwise(F.col("_b")))
             .join(names, "label_cell", "left")
             .select("x", "y", "is_core", F.coalesce(F.col("_id"), F.lit(-1)).cast("int").alias(label)))
    return (pts.join(final, ["x", "y"], "left")
            .select(F.col("_key").alias(key), F.col("x").alias(x), F.col("y").alias(y), F.coalesce(F.col(label), F.lit(-1)).alias(label),
                    F.coalesce("is_core", F.lit(False)).alias("is_core")))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp = smallest node id in its component) by min-label propagation + pointer jumping.

    Each round is checkpointed to the shared checkpoint folder (no lineage growth); labels only
    get smaller, so the rounds end.
    """
    lab = nodes.select("node", F.col("node").alias("comp")).checkpoint(eager=True)
    while True:
        nbr = (edges.join(lab.select(F.col("node").alias("dst"), F.col("comp").alias("c")), "dst")
               .groupBy("src").agg(F.min("c").alias("m")))
        step = (lab.join(nbr.withColumnRenamed("src", "node"), "node", "left")
                .select("node", F.least("comp", F.coalesce("m", "comp")).alias("comp")))
        jump = (step.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("c2")), "comp", "left")
                .select("node", F.least("comp", F.coalesce("c2", "comp")).alias("comp")))
        new = jump.checkpoint(eager=True)
        changed = new.join(lab.withColumnRenamed("comp", "old"), "node").filter(F.col("comp") != F.col("old")).count()
        lab = new
        if changed == 0:
            return lab
