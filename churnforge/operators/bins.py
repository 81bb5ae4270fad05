"""Rows as bin numbers, and sums of them by (node of a tree, feature, bin): what boosted trees and forests share.

A feature's values become at most 256 bins (a byte). Sums by bin of all features are taken in few passes: features are packed
into groups of a few bits (``groups_of``), one count by the group's joint code serves all its features, and sums of
the joint counts are those of each feature (``Sums``). Rows go through a tree as sets of bits, eight rows a byte (``Tests``).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LEAST_GAIN = 1e-12  # relative to the node's own sum of squares; smaller ones are rounding
CELLS = 65_536  # joint codes x nodes that are counted at once: a table that stays in a core's cache
LEAST_CELLS = 4_096
PAIR_BITS = 7  # bits of a group's code where two groups are counted together


def cuts_of(values: np.ndarray, most: int) -> np.ndarray:
    """Thresholds of a feature: between all values, or at most ``most`` that part the rows evenly."""
    found, count = np.unique(values[~np.isnan(values)], return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) <= most:
        return between
    targets = np.arange(1, most + 1) * count.sum() / (most + 1)
    return between[np.unique(np.minimum(np.searchsorted(count.cumsum(), targets), len(between) - 1))]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(feature, row) -> bin: how many thresholds lie below the value."""
    return np.array([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], np.uint8).reshape(len(cuts), len(x))


def share_of(said: str, features: int) -> int:
    """Features that a node may choose from, by MLlib's ``featureSubsetStrategy``."""
    if said in ("all", "auto"):
        return features
    if said in ("sqrt", "log2", "onethird"):
        return int(np.ceil({"sqrt": np.sqrt(features), "log2": max(1.0, np.log2(features)), "onethird": features / 3}[said]))
    return min(features, int(said)) if said.isdigit() else int(np.ceil(float(said) * features))


class Tree:
    """A tree of fixed depth as a heap; a leaf above the last level sends its rows to the left all the way down."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature = np.zeros(2 ** depth - 1, np.int64)
        self.cut = np.full(2 ** depth - 1, 255, np.int64)
        self.value = np.zeros(2 ** depth)

    def route(self, tests: "Tests", levels: int) -> np.ndarray:
        """Each row's node (from 0) in a level: a bit for every level, found by walking the tree with sets of rows."""
        rights = np.zeros((levels, len(tests.whole)), np.uint8)
        room = np.empty((2, levels, len(tests.whole)), np.uint8)
        feature, cut = self.feature.tolist(), self.cut.tolist()

        def walk(node: int, level: int, rows: np.ndarray) -> None:
            if cut[node] >= 255:
                return
            right = np.bitwise_and(rows, tests(feature[node], cut[node]), out=room[0, level])
            np.bitwise_or(rights[level], right, out=rights[level])
            if level + 1 < levels:
                walk(2 * node + 1, level + 1, np.bitwise_xor(rows, right, out=room[1, level]))
                walk(2 * node + 2, level + 1, right)

        if levels:
            walk(0, 0, tests.whole)
        at = np.zeros(tests.rows, np.uint8 if levels <= 8 else np.uint16)
        for bits in rights:
            at <<= 1
            at |= np.unpackbits(bits, count=tests.rows)
        return at

    def predict(self, tests: "Tests") -> np.ndarray:
        return self.value.take(self.route(tests, self.depth))


class Tests:
    """(feature, cut) -> the set of rows whose bin is larger, a bit a row; made at first use."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.rows = codes, codes.shape[1]
        self.whole = np.packbits(np.ones(self.rows, bool))
        self.sets: dict[tuple[int, int], np.ndarray] = {}

    def __call__(self, feature: int, cut: int) -> np.ndarray:
        found = self.sets.get((feature, cut))
        if found is None:
            found = self.sets[feature, cut] = np.packbits(self.codes[feature] > cut)
        return found


def groups_of(sizes: tuple[int, ...], bits: int) -> list[list[tuple[int, int]]]:
    """Groups of (feature, shift): features share a group while its code has at most ``bits`` bits; each group has one at least."""
    groups: list[list[tuple[int, int]]] = []
    used: list[int] = []
    for j in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        need = (sizes[j] - 1).bit_length()
        at = next((g for g, u in enumerate(used) if u + need <= bits), None)
        if at is None:
            groups.append([])
            used.append(0)
            at = len(groups) - 1
        groups[at].append((j, used[at]))
        used[at] += need
    return groups


@lru_cache(maxsize=64)
def _layout(sizes: tuple[int, ...], bits: int) -> list[tuple]:
    """Of every group: its features, the bits of its code, (codes x bins) of zeros and ones, and the bins' places in a node's table.

    The product of sums by code with the zeros and ones gives sums by bin.
    """
    starts, out = np.r_[0, np.cumsum(sizes)], []
    for group in groups_of(sizes, bits):
        need = max(shift + (sizes[j] - 1).bit_length() for j, shift in group)
        code = np.arange(1 << need)
        ones = [((code >> shift) & ((1 << (sizes[j] - 1).bit_length()) - 1))[:, None] == np.arange(sizes[j]) for j, shift in group]
        out.append((group, need, np.concatenate(ones, axis=1).astype(float), np.concatenate([np.arange(starts[j], starts[j + 1]) for j, _ in group])))
    return out


class Sums:
    """Adds values of rows by (node, bin) through joint codes of features; how many share a code depends on the nodes and rows."""

    def __init__(self, sizes: np.ndarray, nodes: int, rows: int = 2 * CELLS):
        self.nodes, self.width = nodes, min(16, max(5, (max(min(rows // 2, CELLS), LEAST_CELLS) // max(nodes, 1)).bit_length() - 1))
        self.bins, self.layout = int(sizes.sum()), _layout(tuple(sizes.tolist()), self.width)

    def packed(self, codes: np.ndarray) -> list[np.ndarray]:
        """The joint codes of every row."""
        out = []
        for group, *_ in self.layout:
            code = np.zeros(codes.shape[1], np.uint16)
            for j, shift in group:
                code |= codes[j].astype(np.uint16) << np.uint16(shift)
            out.append(code)
        return out

    def empty(self, values: int) -> list[np.ndarray]:
        return [np.zeros((values, self.nodes << need)) for _, need, *_ in self.layout]

    def add(self, joint: list[np.ndarray], packs: list[np.ndarray], node: np.ndarray, values: list[np.ndarray]) -> None:
        node = node.astype(np.int64)
        for table, pack, (_, need, *_) in zip(joint, packs, self.layout):
            place = (node << need) + pack
            for side, v in enumerate(values):
                table[side] += np.bincount(place, v, table.shape[1])

    def by_bin(self, joint: list[np.ndarray]) -> np.ndarray:
        """(values, nodes, bins of all features)."""
        out = np.zeros((len(joint[0]), self.nodes, self.bins))
        for table, (_, need, ones, places) in zip(joint, self.layout):
            out[:, :, places] = (table.reshape(-1, 1 << need) @ ones).reshape(len(table), self.nodes, -1)
        return out


class PairSums:
    """Adds values of rows by (node, pair of bins of two features) through joint codes of two groups of features."""

    def __init__(self, sizes: np.ndarray, nodes: int):
        self.sizes, self.nodes, self.layout = sizes, nodes, _layout(tuple(sizes.tolist()), PAIR_BITS)
        self.pairs = list(combinations(range(len(self.layout)), 2)) or [(0, None)]
        self.shapes = [tuple(1 if g is None else 1 << self.layout[g][1] for g in pair) for pair in self.pairs]
        self.cells = nodes * sum(a * b for a, b in self.shapes)

    packed = Sums.packed

    def empty(self, values: int) -> list[np.ndarray]:
        return [np.zeros((values, self.nodes * a * b)) for a, b in self.shapes]

    def add(self, joint: list[np.ndarray], packs: list[np.ndarray], node: np.ndarray, values: list[np.ndarray]) -> None:
        node = node.astype(np.int64)
        for table, (g, h), (a, b) in zip(joint, self.pairs, self.shapes):
            place = node * a + packs[g]
            if h is not None:
                place = place * b + packs[h]
            for side, v in enumerate(values):
                table[side] += np.bincount(place, v, table.shape[1])

    def by_pair(self, joint: list[np.ndarray], starts: dict[tuple, int], width: int) -> np.ndarray:
        """(values, nodes, width): the block of features (i, j), i < j, begins at its start, bins of i by bins of j."""
        values = len(joint[0])
        out, of = np.zeros((values, self.nodes, width)), np.repeat(np.arange(len(self.sizes)), self.sizes)

        def put(block: np.ndarray, places_g: np.ndarray, places_h: np.ndarray) -> None:
            for i in np.unique(of[places_g]):
                for j in np.unique(of[places_h]):
                    key = (int(min(i, j)), int(max(i, j)))
                    if i == j or (i > j and places_g is places_h):
                        continue
                    part = block[:, :, of[places_g] == i][:, :, :, of[places_h] == j]
                    part = part if i < j else part.swapaxes(2, 3)
                    out[:, :, starts[key]:starts[key] + part.shape[2] * part.shape[3]] = part.reshape(values, self.nodes, -1)

        alone: set[int] = set()
        for table, (g, h), (a, b) in zip(joint, self.pairs, self.shapes):
            cube = table.reshape(values, self.nodes, a, b)
            for group, side in ((g, cube.sum(3)), (h, cube.sum(2))):
                if group is not None and group not in alone:
                    alone.add(group)
                    ones, places = self.layout[group][2:]
                    put(np.einsum("vnc,cp,cq->vnpq", side, ones, ones, optimize=True), places, places)
            if h is not None:
                put(self.layout[g][2].T @ cube @ self.layout[h][2], self.layout[g][3], self.layout[h][3])
        return out
