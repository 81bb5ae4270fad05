"""Near duplicates by circulant MinHash, exact at the threshold.

Two permutations of the 32-bit ring make the whole signature: the first spreads
the shingles, the second is applied after a circular shift that grows with the
coordinate. ``BANDS`` bands of ``ROWS`` coordinates find candidates; with 40 bands of 5 a pair at
similarity 0.8 misses all of them with probability 1.3e-7.

1. Documents with the same shingle set are one node (the smallest doc_id).
2. Each band bucket links its nodes to its smallest one; the components of
   these links are clusters, and every true link lies inside a cluster.
3. Shingle sets are read again for nodes in clusters only, and each cluster
   decides its links on full sets: a node whose shingles are too often its own cannot be linked,
   the others are compared with all, one after the other, except those already in the component of the
   first that had a link: their links to nodes outside are found from the outside. A cluster of more than
   ``PART`` shingles is cut into parts, and every two parts meet in a task of bounded size.
4. A whole cluster's task names its groups; groups of parts are joined by their components.

Defined results: null and empty texts, and texts of white space, have an empty set and are alone;
fewer words than a shingle form one shingle; rows that share a doc_id are one
node per set and joined by it; a null doc_id is never linked (component null, kept); an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from churnforge.llm.common import ragged, slices, stored, texts_of
from churnforge.llm.components import components

ROWS, BANDS = 5, 40
SHIFT = np.uint32(0x9E3779B1)  # odd, so shifts of different coordinates differ
PART = 1 << 22  # shingles of a cluster that one task compares
BROADCAST_ROWS = 500_000  # candidate nodes that are sent to every task; more are joined by a shuffle
CHUNK = 1 << 15


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = words.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, bool)
    ends = np.r_[0, np.cumsum(real)][np.asarray(words.offsets)]
    coded = flat.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = hashes[coded.indices.to_numpy()[real]] if len(flat) else np.empty(0, np.uint64)
    lens, start = np.diff(ends), ends[:-1]
    rolled = _mix64(h)
    for j in range(1, width):
        rolled = _mix64(rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[j:]) if len(rolled) else rolled
    out = []
    for s, n in zip(start.tolist(), lens.tolist()):
        if n >= width:
            out.append(np.unique(rolled[s:s + n - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[s:s + n].tobytes())], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], size: int = ROWS * BANDS) -> np.ndarray:
    """Circulant MinHash signatures (texts x size) of non-empty sets."""
    lens = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.empty((len(sets), size), np.uint32)
    part = np.cumsum(lens) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sets)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        first = (_mix64(np.concatenate(sets[a:b])) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(lens[a:b]) - lens[a:b]
        v, t = np.empty_like(first), np.empty_like(first)
        for k in range(size):
            np.add(first, np.uint32(k * int(SHIFT) & 0xFFFFFFFF), out=v)
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                np.right_shift(v, np.uint32(shift), out=t)
                np.bitwise_xor(v, t, out=v)
                np.multiply(v, np.uint32(factor), out=v)
            np.right_shift(v, np.uint32(16), out=t)
            np.bitwise_xor(v, t, out=v)
            out[a:b, k] = np.minimum.reduceat(v, starts)
    return out


def sign(docs: DataFrame, width: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_key (of the whole set), bands."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_of(part), width)
                has = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in has])
                keys, bands = [None] * len(sets), [None] * len(sets)
                for i, row in zip(has, sig):
                    keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    bands[i] = [xxhash.xxh3_64_intdigest(row[j:j + ROWS].tobytes(), b) - (1 << 63) for b, j in enumerate(range(0, ROWS * BANDS, ROWS))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, cluster) of nodes that share a band bucket with another one, directly or by a chain."""
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    first = buckets.groupBy("band", "bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first != last").drop("last")
    stars = buckets.join(first, ["band", "bucket"]).where("node != first").select("node", "first").distinct()
    found = components(stars)
    roots = found.select(F.col("root").alias("node")).distinct()
    return found.select("node", F.col("root").alias("cluster")).unionByName(roots.select("node", F.col("node").alias("cluster")))


def linked(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(node, smallest node of its group) of all others in groups linked at 100 * intersection >= percent * union; sets of one node are one group."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    live = np.arange(len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    while True:  # shingles that no other set has bound every similarity of their set from above
        inside = np.isin(owner, live)
        _, code, times = np.unique(flat[inside], return_inverse=True, return_counts=True)
        shared = np.bincount(owner[inside], times[code] > 1, len(sets))
        still = live[100 * shared[live] >= percent * size[live]]
        if len(still) == len(live):
            break
        live = still
    if len(live) < 2:
        return []
    own = owner[inside]
    order = np.argsort(code, kind="stable")
    posting, at = own[order], np.r_[0, np.cumsum(times)]
    begin = np.r_[0, np.cumsum(np.bincount(own, minlength=len(sets)))]  # flat is in order of owners
    root = np.arange(len(sets))
    members = {i: [i] for i in live.tolist()}
    def join(x: int, y: int) -> None:
        if root[y] != root[x]:
            big, small = sorted((root[x], root[y]), key=lambda r: -len(members[r]))
            for z in members.pop(small):
                root[z] = big
                members[big].append(z)

    main = -1
    for x in live[np.argsort(-shared[live], kind="stable")].tolist():
        if main >= 0 and root[x] == root[main]:
            continue
        codes = code[begin[x]:begin[x + 1]]
        common = np.bincount(posting[ragged(at[codes], times[codes])], minlength=len(sets))
        near = np.flatnonzero(100 * common >= percent * (size + size[x] - common))
        for y in near.tolist():
            join(x, y)
        if main < 0 and len(members[root[x]]) > 1:
            main = x
    first: dict[int, int] = {}
    for x in live.tolist():
        join(first.setdefault(int(nodes[x]), x), x)
    out = []
    for group in members.values():
        ids = np.unique(nodes[group]).tolist()
        out += [(i, ids[0]) for i in ids[1:]]
    return out


def confirm(docs: DataFrame, candidates: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root, parts): groups found in clusters or, where parts > 1, in two parts of one; sets are made from the texts again."""
    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_of(part), width)
                same = [i for i, (s, key) in enumerate(zip(sets, part.column(2).to_pylist())) if xxhash.xxh3_128_digest(s.tobytes()) == key]
                if same:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(k).take(pa.array(same)) for k in (0, 2, 3, 4)] + [pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))],
                        names=["node", "set_key", "cluster", "parts", "shingles"])

    def decide(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.drop_duplicates(["node", "set_key"])
        pairs = linked(df["node"].to_numpy(), [s.view(np.uint64) for s in df["shingles"]], percent)
        return pd.DataFrame(pairs, columns=["node", "root"], dtype="int64").assign(parts=key[3])

    sizes = candidates.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / PART).alias("parts"))
    placed = candidates.join(sizes, "cluster").select(F.col("node").alias("doc_id"), "set_key", "cluster", "parts")
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    texts = docs.select("doc_id", "text").join(placed, "doc_id").select("doc_id", "text", "set_key", "cluster", "parts")
    sets = texts.mapInArrow(reread, "node long, set_key binary, cluster long, parts long, shingles array<long>")
    # a part meets itself and every other part of its cluster
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    spread = sets.withColumn("part", part).withColumn("other", others).select(
        "node", "set_key", "shingles", "cluster", "parts", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return spread.groupBy("cluster", "i", "j", "parts").applyInPandas(decide, "node long, root long, parts long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    signed = stored(sign(docs, width), "signatures")
    nodes = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.min("bands").alias("bands"), F.min("n_shingles").alias("n_shingles"))
    found = stored(clusters(nodes), "clusters")
    keyed = stored(nodes.select("node", "set_key", "n_shingles").join(found, "node"), "candidates")
    decided = stored(confirm(docs, keyed, width, percent), "groups")
    groups, pieces = decided.where("parts = 1").select("node", "root"), decided.where("parts > 1").select("node", "root")
    if not pieces.isEmpty():
        groups = groups.unionByName(components(pieces))
    of_key = nodes.select("node", "set_key").join(groups, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    joined = signed.drop("bands").join(of_key, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
