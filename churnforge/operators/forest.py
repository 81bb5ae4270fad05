"""Random forests on numpy blocks: MLlib's model and parameters, all trees of the forest one level a job.

``BaggedTrees`` takes the parameters of ``RandomForestClassifier`` and grows the same model for two classes: Gini impurity by weight,
at least ``minInstancesPerNode`` drawn rows on either side, a draw of ``featureSubsetStrategy`` features for every node, at most
``maxBins`` bins a feature from a sample of at least 10,000 rows, leaves of one parent merged where they say the same class, and
the mean of the leaves' class shares as probability. A tree
draws each row as often as a Poisson number of mean ``subsamplingRate`` says, taken from 16 random bits (so each of its
probabilities is met within 2^-16). Random numbers are not MLlib's, so single trees differ from its own.

Rows are stored once as blocks of bin numbers (a byte a feature) with label and weight. A job grows all trees by one level: a task draws its
rows again from the seed, routes them through each tree and adds them by (node, bin, class) (``bins``); the sums of a tree go to the task
that finds its splits, and only the splits go to the driver. What a task sends has the size of the trees' tables, whatever the number of rows.

Defined results: labels other than 0 and 1 and weights that are missing or negative fail; a tree that drew no row has no vote; an
empty table fails; so does a depth over ``DEEPEST``, whose tables would grow with 2^depth.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame

from churnforge.operators.bins import LEAST_GAIN, Sums, Tests, Tree, share_of
from churnforge.operators.boosting import BoostedModel, blocks_of

CHUNK = 1_048_576  # rows whose sums are held as joint tables before they become tables by bin
SUB = 131_072  # rows that are routed and counted at once
DEEPEST = 14
SENT = 131_072  # nodes of all trees whose tables a task sends at a time


def draws_of(rate: float, bootstrap: bool) -> np.ndarray | None:
    """How often a row is drawn, by 16 random bits; None where every row is taken once."""
    if not bootstrap and rate >= 1:
        return None
    if not bootstrap:
        share = [1 - rate, rate]
    else:
        share = [math.exp(-rate) * rate ** k / math.factorial(k) for k in range(60)]
    ends = np.rint(np.cumsum(share) * 65_536).clip(0, 65_536).astype(np.int64)
    return np.searchsorted(ends, np.arange(65_536), side="right").clip(0, len(share) - 1).astype(np.uint8)


def allowed_of(seed: int, number: int, level: int, nodes: int, features: int, some: int) -> np.ndarray:
    """(node, feature): which features the live nodes of a tree's level may be split by."""
    return np.random.default_rng((seed, 1, number, level)).random((nodes, features)).argsort(1).argsort(1) < some


def gini_splits(raw: np.ndarray, table: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, least: int, least_gain: float) -> tuple[np.ndarray, ...]:
    """(gain x weight, feature, cut, class weights left, right) of every node; a gain of 0 where none parts the rows.

    ``raw`` and ``table`` are (class, node, bin), of rows and of weights. Equal gains go to the first feature and cut.
    """
    nodes, starts = table.shape[1], np.r_[0, sizes.cumsum()]
    best = [np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros((nodes, 2)), np.zeros((nodes, 2))]
    each = np.arange(nodes)
    for j, size in enumerate(sizes):
        own = np.flatnonzero(allowed[:, j])
        if size < 2 or not len(own):
            continue
        part = slice(starts[j], starts[j + 1])
        n, v = raw[:, own, part].sum(0), table[:, own, part]
        nl = n.cumsum(1)[:, :-1]
        nr = n.sum(1)[:, None] - nl
        left = v.cumsum(2)[:, :, :-1]
        right = v[:, :, ::-1].cumsum(2)[:, :, ::-1][:, :, 1:]
        wl, wr, whole = left.sum(0), right.sum(0), v.sum(2)
        w = whole.sum(0)
        ok = (nl >= least) & (nr >= least) & (wl > 0) & (wr > 0)
        wl, wr = np.where(ok, wl, 1), np.where(ok, wr, 1)
        before = np.divide((whole ** 2).sum(0), w, out=np.zeros(len(own)), where=w > 0)
        gain = np.where(ok, (left ** 2).sum(0) / wl + (right ** 2).sum(0) / wr - before[:, None], 0)
        cut = gain.argmax(1)
        row = each[:len(own)]
        found = gain[row, cut]
        better = (found > np.maximum(best[0][own], LEAST_GAIN * before)) & (found >= least_gain * w)
        to, at, c = own[better], row[better], cut[better]
        best[0][to], best[1][to], best[2][to] = found[better], j, c
        best[3][to], best[4][to] = left[:, at, c].T, right[:, at, c].T
    return tuple(best)


def _tables(trees: dict[int, tuple[Tree, np.ndarray]], level: int, sizes: np.ndarray, some: int, draws: np.ndarray | None, seed: int, by_class: bool):
    """The task's function of a pass: (tree, sums by class and by the bins that its live nodes may use).

    ``trees`` has each growing tree with its live nodes. Sums are of rows and, unless a class has one weight, of weights too.
    """
    def add(part: int, blocks: Iterator) -> Iterator[tuple[int, np.ndarray]]:
        for k, (codes, y, w) in enumerate(_chunks(blocks)):
            n, up, packs_of = len(y), y > 0, {}
            parts = [slice(lo, min(lo + SUB, n)) for lo in range(0, n, SUB)]
            tests = [Tests(codes[:, here]) for here in parts]
            for number, (tree, live) in trees.items():
                nodes = len(live)
                sums = Sums(sizes, 2 * nodes + 2, n)  # two classes, and a node for rows whose own is a leaf
                if sums.width not in packs_of:
                    packs_of[sums.width] = sums.packed(codes)
                packs, joint = packs_of[sums.width], sums.empty(1 if by_class else 2)
                slot = np.full(2 ** level, nodes, np.int32)
                slot[live] = np.arange(nodes)
                drawn = None
                if draws is not None:
                    bits = np.random.default_rng((seed, 0, number, part, k)).integers(0, 2 ** 64, (n + 3) // 4, np.uint64)
                    drawn = draws.take(bits.view(np.uint16)[:n])
                for here, test in zip(parts, tests):
                    node = 2 * slot.take(tree.route(test, level)) + up[here]
                    times = drawn[here].astype(float) if draws is not None else np.ones(len(node))
                    sums.add(joint, [p[here] for p in packs], node, [times] if by_class else [times, times * w[here]])
                out = sums.by_bin(joint)[:, :2 * nodes].reshape(-1, nodes, 2, int(sizes.sum())).transpose(0, 2, 1, 3)
                out = out[:, :, _bins(allowed_of(seed, number, level, nodes, len(sizes), some), sizes)]
                yield number, out.astype(np.int64) if by_class else out

    return add


def _chunks(blocks: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks put together up to ``CHUNK`` rows."""
    held: list[tuple] = []
    for codes, y, w, _ in blocks:
        if held and sum(len(h[1]) for h in held) + len(y) > CHUNK:
            yield tuple(np.concatenate(v, axis=-1) for v in zip(*held))
            held.clear()
        held.append((codes, y, w))
    if held:
        yield tuple(np.concatenate(v, axis=-1) for v in zip(*held))


def _bins(allowed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(node, bin): the bins of the allowed features."""
    return np.repeat(allowed, sizes, axis=1)


def _splits(live: dict[int, int], level: int, sizes: np.ndarray, some: int, seed: int, by_class: np.ndarray | None, least: int, least_gain: float):
    """The function of (tree, added sums): (tree, (root's class weights, its best splits))."""
    def find(kv: tuple[int, np.ndarray]) -> tuple[int, tuple]:
        number, flat = kv
        allowed = allowed_of(seed, number, level, live[number], len(sizes), some)
        full = np.zeros((len(flat), 2, live[number], int(sizes.sum())))
        full[:, :, _bins(allowed, sizes)] = flat
        weights = full[1] if by_class is None else full[0] * by_class[:, None, None]
        first = int(allowed[0].argmax())
        start = int(sizes[:first].sum())
        return number, (weights[:, 0, start:start + sizes[first]].sum(1), gini_splits(full[0], weights, sizes, allowed, least, least_gain))

    return find


class BaggedTrees(RandomForestClassifier):
    """``RandomForestClassifier`` by its parameters, fitted by this module's passes."""

    def _fit(self, dataset: DataFrame) -> "BaggedModel":
        if self.getMaxDepth() > DEEPEST:
            raise ValueError(f"depth {self.getMaxDepth()} is more than {DEEPEST}")
        blocks, cuts, _ = blocks_of(self, dataset)
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            trees, gains = self._grow(blocks, cuts)
        finally:
            blocks.unpersist()
        voters = max(len(trees), 1)
        state = {"cuts": [c.tolist() for c in cuts], "steps": [1 / voters] * len(trees), "gains": gains.tolist(), "depth": self.getMaxDepth(),
                 "trees": [[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in trees]}
        model = BaggedModel()
        model._set(state=json.dumps(state), featuresCol=self.getFeaturesCol(), probabilityCol=self.getProbabilityCol(), predictionCol=self.getPredictionCol())
        return model

    def _grow(self, blocks: RDD, cuts: list[np.ndarray]) -> tuple[list[Tree], np.ndarray]:
        depth, seed, sizes = self.getMaxDepth(), abs(self.getSeed()), np.array([len(c) + 1 for c in cuts])
        said = self.getFeatureSubsetStrategy()
        some = share_of("sqrt" if said == "auto" and self.getNumTrees() > 1 else said, len(cuts))
        draws = draws_of(self.getSubsamplingRate(), self.getBootstrap())
        by_class = _weights_by_class(blocks)
        trees = [Tree(depth) for _ in range(self.getNumTrees())]
        live = {k: np.array([0]) for k in range(len(trees))} if depth else {}
        own = np.zeros((len(trees), 2 ** (depth + 1) - 1, 2))  # class weights of every node
        gains = np.zeros((len(trees), 2 ** depth - 1))
        spark = blocks.context
        for level in range(depth):
            following: dict[int, np.ndarray] = {}
            numbers = sorted(live)
            batch = max(1, SENT >> level)
            for at in range(0, len(numbers), batch):
                some_trees = numbers[at:at + batch]
                sent = spark.broadcast({k: (trees[k], live[k]) for k in some_trees})
                counts = {k: len(live[k]) for k in some_trees}

                def add(part, own, sent=sent, level=level):
                    return _tables(sent.value, level, sizes, some, draws, seed, by_class is not None)(part, own)
                found = (blocks.mapPartitionsWithIndex(add).reduceByKey(np.add, min(len(some_trees), max(spark.defaultParallelism, blocks.getNumPartitions())))
                         .map(_splits(counts, level, sizes, some, seed, by_class, self.getMinInstancesPerNode(), self.getMinInfoGain())).collect())
                sent.unpersist()
                for k, (root, (gain, feature, cut, left, right)) in found:
                    did, first = gain > 0, 2 ** level - 1
                    node = first + live[k][did]
                    if level == 0:
                        own[k, 0] = root
                    trees[k].feature[node], trees[k].cut[node], gains[k, node] = feature[did], cut[did], gain[did]
                    own[k, 2 * node + 1], own[k, 2 * node + 2] = left[did], right[did]
                    children = np.stack([2 * node + 1, 2 * node + 2], axis=1).reshape(-1)
                    mixed = children[(own[k, children] > 0).all(1)]  # a node of one class is a leaf
                    if len(mixed):
                        following[k] = mixed - (2 ** (level + 1) - 1)
            live = following
            if not live:
                break
        voting = [k for k in range(len(trees)) if own[k, 0].sum() > 0]
        shares = np.zeros(len(cuts))
        for k in voting:
            finished(trees[k], own[k])
            split = trees[k].cut < 255
            by_feature = np.bincount(trees[k].feature[split], gains[k, split], len(cuts))
            shares += by_feature / max(by_feature.sum(), 1e-300)
        return [trees[k] for k in voting], shares


def finished(tree: Tree, own: np.ndarray) -> None:
    """Leaves of one parent that say the same class are merged, as MLlib does; then every leaf gets its share of the second class."""
    says, leaf = own[:, 1] > own[:, 0], np.ones(len(own), bool)
    leaf[:len(tree.cut)] = tree.cut >= 255
    for level in range(tree.depth - 1, -1, -1):
        node = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
        left, right = 2 * node + 1, 2 * node + 2
        node = node[~leaf[node] & leaf[left] & leaf[right] & (says[left] == says[right])]
        leaf[node], tree.cut[node], tree.feature[node] = True, 255, 0
    reached = np.zeros(len(own), bool)
    reached[0] = True
    for level in range(tree.depth + 1):
        node = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
        node = node[reached[node]]
        tree.value[(node - (2 ** level - 1)) << (tree.depth - level)] = own[node, 1] / own[node].sum(1)
        node = node[~leaf[node]]
        reached[2 * node + 1] = reached[2 * node + 2] = True


def _weights_by_class(blocks: RDD) -> np.ndarray | None:
    """The weight of both classes where it is the same for all rows of a class; None otherwise."""
    def ends(own: Iterator) -> Iterator[np.ndarray]:
        out = np.array([[np.inf, -np.inf]] * 2)
        for _, y, w, _ in own:
            for c, side in enumerate((-1, 1)):
                v = w[y == side]
                if len(v):
                    out[c] = min(out[c, 0], v.min()), max(out[c, 1], v.max())
        yield out

    all_ends = np.stack(blocks.mapPartitions(ends).collect())
    low, high = all_ends[:, :, 0].min(0), all_ends[:, :, 1].max(0)
    return np.where(np.isfinite(low), low, 0.0) if (high <= low).all() else None


class BaggedModel(BoostedModel):
    """The mean of the trees' shares of the second class."""

    @staticmethod
    def _chance(total):
        return np.clip(total, 0.0, 1.0)
