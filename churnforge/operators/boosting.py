"""Gradient-boosted trees on numpy blocks: MLlib's model and parameters, a job of one stage for one or two levels of a tree.

``BoostedTrees`` takes the parameters of ``GBTClassifier`` and grows the same model: logistic loss on labels of
-1 and 1, regression trees on the residuals 4y / (1 + exp(2yF)) with variance as impurity, leaves that hold the weighted
mean residual, the first tree with weight 1 and the others with ``stepSize``, and at most ``maxBins`` bins a feature from
a sample of at least 10,000 rows, which takes every value of a feature that has no more. A tree sees each row with
probability ``subsamplingRate`` and a node each set of ``featureSubsetStrategy`` features alike. Random numbers are not
MLlib's, so single trees differ from its own.

Rows are stored once as blocks of bin numbers (a byte a feature) with label, weight and margin. A pass routes the rows of a
block through the tree so far and adds weight and residual by (node, bin); a task leaves one table of (nodes x bins) sums,
and the driver holds the sum of them, whatever the number of rows. Where a task has few rows, its table is by pairs of bins: from
these the next level follows exactly (a child's sums by bin are the pair's sums over the parent's side), so a job serves two levels.
After a tree the blocks are stored with new margins; every ``EVERY`` trees they are checkpointed, so lineage stays short.

Defined results: labels other than 0 and 1 and weights that are missing or negative fail, as do missing features; a table
of one class gives one leaf; an empty table fails.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.operators.bins import LEAST_GAIN, PairSums, Sums, Tests, Tree, binned, cuts_of, share_of
from churnforge.session import checkpoint_dir, release_scratch

BLOCK = 262_144  # rows that are counted at once
EVERY = 25  # trees between two checkpoints of the margins
SAMPLE = 10_000  # rows for the bins, at least
MANY = 64  # tasks whose tables are added on the executors before they go to the driver
PAIR_WORK = 300_000_000  # rows x pairs of features in a task, up to which counting pairs costs less than a job of its own for the next level
PAIR_CELLS = 131_072  # pairs of bins of all nodes in a task's table
PAIR_JOINT = 4_194_304  # cells of the joint tables of two groups of features that a task holds


def residual(y: np.ndarray, margin: np.ndarray, first: bool) -> np.ndarray:
    return y.astype(float) if first else 4 * y / (1 + np.exp(2 * y * margin))


def _starts(sizes: np.ndarray, pairs: bool) -> dict[tuple, int]:
    """Where the bins of a feature, or of two together, begin in a node's table; the last key is its width."""
    keys = list(combinations(range(len(sizes)), 2)) if pairs else [(j,) for j in range(len(sizes))]
    ends = np.cumsum([0] + [int(np.prod(sizes[list(k)])) for k in keys])
    return dict(zip([*keys, ()], ends.tolist()))


def _sums(tree: Tree, level: int, live: np.ndarray, sizes: np.ndarray, pairs: bool, number: int, rate: float, seed: int):
    """The task's function of a pass: (2, live nodes, width) sums of weight and weighted residual by bin, or by pairs of bins."""
    slot = np.full(2 ** level, -1)
    slot[live] = np.arange(len(live))
    starts = _starts(sizes, pairs) if pairs else {}
    width = starts.pop((), 0)

    def add(part: int, blocks: Iterator) -> Iterator[np.ndarray]:
        nodes = len(live)
        sums = (PairSums if pairs else Sums)(sizes, nodes)
        joint = sums.empty(2)
        for k, (codes, y, w, margin) in enumerate(blocks):
            if rate < 1:
                w = w * (np.random.default_rng((seed, number, part, k)).random(len(y), np.float32) < rate)
            at = slot.take(tree.route(Tests(codes), level))
            if nodes < 2 ** level:
                some = at >= 0
                at, codes, y, w, margin = at[some], codes[:, some], y[some], w[some], margin[some]
            sums.add(joint, sums.packed(codes), at, [w, w * residual(y, margin, number == 0)])
        yield sums.by_pair(joint, starts, width) if pairs else sums.by_bin(joint)

    return add


def _single(pairs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The table by bin from one by pairs of bins."""
    starts, first = _starts(sizes, True), []
    for j in range(len(sizes)):
        key = (0, j) if j else (0, 1)
        block = pairs[:, :, starts[key]:starts[key] + sizes[key[0]] * sizes[key[1]]].reshape(*pairs.shape[:2], sizes[key[0]], sizes[key[1]])
        first.append(block.sum(2 if j else 3))
    return np.concatenate(first, axis=2)


def _children(pairs: np.ndarray, single: np.ndarray, sizes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The tables by bin of the left and right parts of every node, from its table by pairs of bins."""
    starts, at = _starts(sizes, True), np.r_[0, sizes.cumsum()]
    out = np.zeros((2, 2 * len(feature), single.shape[2]))
    for node, (f, c) in enumerate(zip(feature, cut)):
        for j in range(len(sizes)):
            to = slice(at[j], at[j + 1])
            if j == f:
                out[:, 2 * node, at[j]:at[j] + c + 1] = single[:, node, at[j]:at[j] + c + 1]
                out[:, 2 * node + 1, at[j] + c + 1:at[j + 1]] = single[:, node, at[j] + c + 1:at[j + 1]]
                continue
            key = (min(f, j), max(f, j))
            block = pairs[:, node, starts[key]:starts[key] + sizes[f] * sizes[j]].reshape(2, sizes[key[0]], sizes[key[1]])
            block = block if f < j else block.swapaxes(1, 2)
            out[:, 2 * node, to], out[:, 2 * node + 1, to] = block[:, :c + 1].sum(1), block[:, c + 1:].sum(1)
    return out


def _total(tables: RDD) -> np.ndarray:
    """The sum of the tasks' tables; those of many tasks are added on the executors first."""
    if tables.getNumPartitions() > MANY:
        return tables.treeReduce(np.add)
    return sum(tables.collect())


def best_splits(table: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gain x weight, feature, cut, mean left, mean right) of every node; a gain of 0 where none parts the rows.

    ``table`` is (2, nodes, bins), ``allowed`` (nodes, features). Equal gains go to the first feature and cut.
    """
    nodes, starts = table.shape[1], np.r_[0, sizes.cumsum()]
    best = [np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes), np.zeros(nodes)]
    w, s = table[:, :, :starts[1]].sum(axis=2)
    whole = np.divide(s * s, w, out=np.zeros(nodes), where=w > 0)
    for j, size in enumerate(sizes):
        if size < 2:
            continue
        weight, total = table[:, :, starts[j]:starts[j + 1]]
        wl, sl = weight.cumsum(1)[:, :-1], total.cumsum(1)[:, :-1]
        wr, sr = weight[:, ::-1].cumsum(1)[:, ::-1][:, 1:], total[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
        ok = (wl > 0) & (wr > 0) & allowed[:, j:j + 1]
        wl, wr = np.where(ok, wl, 1), np.where(ok, wr, 1)
        gain = np.where(ok, sl * sl / wl + sr * sr / wr - whole[:, None], 0)
        cut = gain.argmax(1)
        each = np.arange(nodes)
        better = gain[each, cut] > np.maximum(best[0], LEAST_GAIN * whole)
        found = gain[each, cut], np.full(nodes, j), cut, (sl / wl)[each, cut], (sr / wr)[each, cut]
        for b, v in zip(best, found):
            b[better] = v[better]
    return tuple(best)


def _stored(rows: DataFrame, cuts: list[np.ndarray]) -> RDD:
    """Blocks of (bins, labels of -1 and 1, weights, margins of 0) of (features, label, weight)."""
    width = len(cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block():
            codes, y, w = (np.concatenate(v, axis=-1) for v in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (codes, y, w)], names=["codes", "y", "w"])

        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            held.append((binned(x, cuts), (2 * b.column(1).to_numpy(zero_copy_only=False) - 1).astype(np.int8), b.column(2).to_numpy(zero_copy_only=False)))
            if sum(len(h[1]) for h in held) >= BLOCK:
                yield block()
        if held:
            yield block()

    def arrays(row):
        y = np.frombuffer(row["y"], np.int8)
        return np.frombuffer(row["codes"], np.uint8).reshape(width, len(y)), y, np.frombuffer(row["w"], np.float64), np.zeros(len(y))

    return rows.mapInArrow(pack, "codes binary, y binary, w binary").rdd.map(arrays)


def blocks_of(estimator, dataset: DataFrame) -> tuple[RDD, list[np.ndarray], int]:
    """The blocks of a tree estimator's training rows, its thresholds and the number of rows."""
    label, weight = F.col(estimator.getLabelCol()).cast("double"), F.lit(1.0)
    if estimator.isSet("weightCol"):
        weight = F.col(estimator.getWeightCol()).cast("double")
    said = F.when(label.isin(0.0, 1.0), label).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("double"))
    sound = F.when((weight >= 0) & ~F.isnan(weight), weight).otherwise(F.raise_error(F.lit("weights must not be missing or negative")).cast("double"))
    rows = dataset.select(vector_to_array(estimator.getFeaturesCol()).alias("x"), said.alias("y"), sound.alias("w"))
    n = dataset.count()
    if not n:
        raise ValueError("no training rows")
    enough = max(SAMPLE, estimator.getMaxBins() ** 2)
    sample = rows.select("x") if n <= enough else rows.select("x").sample(False, enough / n, estimator.getSeed())
    seen = np.array([r["x"] for r in sample.collect()])  # a fixed number of rows
    cuts = [cuts_of(seen[:, k], min(estimator.getMaxBins(), 256) - 1) for k in range(seen.shape[1])]
    return _stored(rows, cuts), cuts, n


def _grown(tree: Tree, step: float):
    """The task's function after a tree: the blocks with its predictions in their margins."""
    def grow(blocks: Iterator) -> Iterator[tuple]:
        for codes, y, w, margin in blocks:
            yield codes, y, w, margin + step * tree.predict(Tests(codes))

    return grow


class BoostedTrees(GBTClassifier):
    """``GBTClassifier`` by its parameters, fitted by this module's passes."""

    def _fit(self, dataset: DataFrame) -> "BoostedModel":
        checkpoint_dir(dataset.sparkSession)
        blocks, cuts, n = blocks_of(self, dataset)
        trees, gains = self._grow(dataset.sparkSession, blocks, cuts, n)
        steps = [1.0] + [self.getStepSize()] * (len(trees) - 1)
        state = {"cuts": [c.tolist() for c in cuts], "steps": steps, "gains": gains.tolist(), "depth": self.getMaxDepth(),
                 "trees": [[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in trees]}
        model = BoostedModel()
        model._set(state=json.dumps(state), featuresCol=self.getFeaturesCol(), probabilityCol=self.getProbabilityCol(), predictionCol=self.getPredictionCol())
        return model

    def _grow(self, spark: SparkSession, blocks: RDD, cuts: list[np.ndarray], n: int) -> tuple[list[Tree], np.ndarray]:
        depth, seed = self.getMaxDepth(), abs(self.getSeed())
        sizes, rate = np.array([len(c) + 1 for c in cuts]), self.getSubsamplingRate()
        some, rng = share_of(self.getFeatureSubsetStrategy(), len(cuts)), np.random.default_rng(seed)
        cells = _starts(sizes, True)[()]
        worth = len(cuts) > 1 and n * math.comb(len(cuts), 2) <= PAIR_WORK * blocks.getNumPartitions()
        trees, gains, old, files = [], np.zeros(len(cuts)), [], []

        def split(tree: Tree, level: int, live: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
            """Splits a level; (which nodes were split, their features and cuts, the nodes of the next level)."""
            allowed = rng.random((len(live), len(cuts))).argsort(1).argsort(1) < some
            gain, feature, cut, left, right = best_splits(table, sizes, allowed)
            did, drop = gain > 0, 2 ** (depth - level - 1)
            node = live[did]
            tree.feature[node + 2 ** level - 1], tree.cut[node + 2 ** level - 1] = feature[did], cut[did]
            tree.value[2 * node * drop], tree.value[(2 * node + 1) * drop] = left[did], right[did]
            np.add.at(gains, feature[did], gain[did])
            return did, feature[did], cut[did], np.stack([2 * node, 2 * node + 1], axis=1).reshape(-1)

        now = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for number in range(self.getMaxIter()):
                tree, live, level = Tree(depth), np.array([0]), 0
                while level < depth and len(live):
                    pairs = worth and level + 1 < depth and len(live) * cells <= PAIR_CELLS and PairSums(sizes, len(live)).cells <= PAIR_JOINT
                    table = _total(now.mapPartitionsWithIndex(_sums(tree, level, live, sizes, pairs, number, rate, seed)))
                    single = _single(table, sizes) if pairs else table
                    if level == 0:
                        tree.value[0] = _mean(single, sizes)
                        for o in old:  # the pass has stored the newer margins
                            o.unpersist()
                        old.clear()
                        if now.isCheckpointed():
                            files.append(now.getCheckpointFile())
                            for f in files[:-1]:
                                release_scratch(spark, f)
                            del files[:-1]
                    did, feature, cut, live = split(tree, level, live, single)
                    level += 1
                    if pairs and len(live):
                        live = split(tree, level, live, _children(table[:, did], single[:, did], sizes, feature, cut))[3]
                        level += 1
                trees.append(tree)
                if number + 1 < self.getMaxIter():
                    old.append(now)
                    now = now.mapPartitions(_grown(tree, self.getStepSize() if number else 1.0), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
                    if (number + 1) % EVERY == 0:
                        now.checkpoint()
        finally:
            for r in (*old, now):
                r.unpersist()
            for f in files:
                release_scratch(spark, f)
        return trees, gains


def _mean(table: np.ndarray, sizes: np.ndarray) -> float:
    w, s = table[:, 0, :sizes[0]].sum(axis=1)
    return s / w if w else 0.0


class BoostedModel(Model, HasFeaturesCol, HasProbabilityCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Thresholds and trees; the columns that it adds are those of MLlib's classifiers."""

    state = Param(Params._dummy(), "state", "thresholds, trees, their steps and the features' gains as JSON", TypeConverters.toString)

    @staticmethod
    def _chance(total):
        return 1 / (1 + np.exp(-2 * total))

    def _read(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    @property
    def featureImportances(self) -> DenseVector:
        gains = np.array(self._read()["gains"])
        return DenseVector(gains / gains.sum() if gains.sum() else gains)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = self._read()
        cuts = [np.array(c) for c in state["cuts"]]
        trees = []
        for step, (feature, cut, value) in zip(state["steps"], state["trees"]):
            tree = Tree(state["depth"])
            tree.feature, tree.cut, tree.value = np.array(feature, np.int64), np.array(cut, np.int64), step * np.array(value)
            trees.append(tree)

        link = self._chance

        def score(x: np.ndarray) -> np.ndarray:
            tests = Tests(binned(x, cuts))
            return link(sum((t.predict(tests) for t in trees), np.zeros(len(x))))

        @F.pandas_udf("double")
        def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held: list[np.ndarray] = []

            def scored() -> Iterator[pd.Series]:
                p, at = score(np.concatenate(held)), 0
                for x in held:
                    yield pd.Series(p[at:at + len(x)])
                    at += len(x)
                held.clear()

            for x in batches:  # a walk through the trees costs as much for a few rows as for thousands
                held.append(np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(cuts))))
                if sum(map(len, held)) >= BLOCK:
                    yield from scored()
            if held:
                yield from scored()

        p = F.col(self.getProbabilityCol())
        out = dataset.withColumn(self.getProbabilityCol(), chance(vector_to_array(self.getFeaturesCol())))
        return (out.withColumn(self.getPredictionCol(), (p > 0.5).cast("double"))
                .withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p))))
