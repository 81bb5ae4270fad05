"""Removal of repeated byte strings by minimiser sampling, with fingerprints doubled inside a slice of texts.

A byte goes where a string of ``LENGTH`` bytes covers it that also starts earlier
(smaller document, or same document and earlier start). Ranks are 64-bit fingerprints
made by doubling: the rank of 2n bytes at a position joins the ranks of n bytes there and
n bytes further on. There are no distributed doubling rounds: sorting every byte position by
rank and position in Spark, and reranking at growing offsets until a rank is unique or long enough, would write
16 bytes for each byte of input and round (an estimate from the record's size). Doubling runs inside a
slice of texts instead, and Spark groups sampled positions once by fingerprint and once by window:

1. Every window of LENGTH bytes chooses its position of least 16-byte rank
   (leftmost of equals), so equal windows choose alike; about one position in 40 is chosen. The
   windows that choose a position are a run, and all their bytes together are its neighbourhood.
2. Spark sorts positions by (16-byte rank, neighbourhood rank, document, place).
   A 16-byte rank that occurs once is done. Among equal pairs all but the first are
   repeats with their whole run of windows. First ones whose 16-byte rank goes with other
   neighbourhoods as well may still share single windows.
3. These are sorted once more with the bytes of their neighbourhood, their windows are
   ranked up to the full length, and of equal windows all but the first are repeats.
4. The repeats of each document are merged and cut out of its bytes.

A pair that repeats within a slice of input is settled there, so exact copies of any number reach
the sort once per slice. 16-byte ranks frequent in a sample (a line that very
many documents share) are spread by their neighbourhood, and their windows are
sorted one by one, those that repeat within a batch settled first. The sample only balances; results do not depend on it.

Defined results: null texts are empty; shorter texts than LENGTH keep all bytes; rows that share
a doc_id, or have none, are numbered by (doc_id, text hash), null ids first, and are documents
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from churnforge.llm.common import ragged, slices, stored

LENGTH, GRAM = 100, 16
REACH = LENGTH - GRAM  # a window's start lies at most so many bytes before its position
SAMPLE_DOCS = 2000
HOT_SHARE = 0.01  # so at most 100 hot ranks per position of a typical text
CHUNK = 1 << 19
BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _double(rank: np.ndarray, n: int) -> np.ndarray:
    """Ranks of 2n bytes from ranks of n bytes (the last n positions lose theirs)."""
    return _join(rank[:-n], rank[n:]) if len(rank) > n else rank[:0]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(29)) | (b >> np.uint64(35)))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16-byte ranks, 64-byte ranks) of all positions."""
    rank = BYTE[data]
    for n in (1, 2, 4, 8):
        rank = _double(rank, n)
    gram = rank
    for n in (16, 32):
        rank = _double(rank, n)
    return gram, rank


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, length of each text)."""
    col = texts.cast(pa.binary() if pa.types.is_string(texts.type) else texts.type).cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.empty(0, np.uint8)
    return data[ends[0]:ends[-1]], np.diff(ends)


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def sampled_positions(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram rank, neighbourhood rank, text, place, bytes to the first and last window start) of the chosen positions."""
    many = np.maximum(lens - LENGTH + 1, 0)
    ends = np.cumsum(lens)
    if not many.sum():
        return tuple(np.empty(0, np.uint64 if k < 2 else np.int64) for k in range(6))
    gram, wide = _ranks(data)
    key = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    least = _slide_min(key, REACH + 1)
    start = ragged(ends - lens, many)
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    at, lo, hi = place[first], start[first], start[np.r_[first[1:], len(place)] - 1]
    # 64 bytes from both ends and from the middle cover a neighbourhood of at most 184 bytes
    near = _join(_join(wide[lo], wide[np.minimum(lo + 60, hi + LENGTH - 64)]), _join(wide[hi + LENGTH - 64], (hi - lo).astype(np.uint64)))
    text = np.searchsorted(ends, at, side="right")
    return gram[at], near, text, at - (ends - lens)[text], at - lo, at - hi


def _chunks(lens: np.ndarray) -> list[tuple[int, int]]:
    part = np.cumsum(lens) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lens)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def _positions(texts: pa.Array, docs: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
    """Rows (g, c, doc, pos) of a slice; pos packs place, both run ends, and the flags hot and settled."""
    data, lens = _bytes_of(texts)
    ends = np.cumsum(lens)
    parts = []
    for a, b in _chunks(lens):
        g, c, text, *rest = sampled_positions(data[ends[a] - lens[a]:ends[b - 1]], lens[a:b])
        parts.append((g, c, docs[a + text], *rest))
    g, c, doc, place, lo, hi = (np.concatenate(x) for x in zip(*parts))
    pos = place << 16 | lo << 9 | hi << 2 | np.isin(g, hot).astype(np.int64) << 1
    order = np.lexsort((pos, doc, c, g))
    g, c, doc, pos = g[order], c[order], doc[order], pos[order]
    again = np.r_[False, (g[1:] == g[:-1]) & (c[1:] == c[:-1])] if len(g) else np.empty(0, bool)
    pos[again] |= 1  # settled: a repeat of the slice's first, wherever it is sent
    g[again] = _join(doc[again].astype(np.uint64), pos[again].astype(np.uint64))
    return {"g": g.view(np.int64), "c": c.view(np.int64), "doc": doc, "pos": pos}


POSITIONS = "g long, c long, doc long, pos long"


def positions(numbered: DataFrame, hot: list[int]) -> DataFrame:
    hot = np.array(hot, dtype=np.int64).view(np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                rows = _positions(part.column(1), np.asarray(part.column(0)), hot)
                if len(rows["g"]):
                    yield pa.RecordBatch.from_pydict(rows)

    return numbered.mapInArrow(each, POSITIONS)


def neighbourhoods(numbered: DataFrame, unclear: DataFrame) -> DataFrame:
    """Rows (key, doc, pos, bytes) of the unclear positions: one per position, or one per window where it is hot.

    A hot window that repeats within a batch is settled there; the runs of settled windows go on as
    rows without bytes, marked in pos and under a key of their own.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {"key": [], "doc": [], "pos": [], "bytes": []}

        def add(*row) -> None:
            for column, v in zip(out.values(), row):
                column.append(v)

        for batch in batches:
            seen: set[bytes] = set()
            docs = batch.column(0).to_pylist()
            for k in sorted(range(len(docs)), key=docs.__getitem__):  # the first of equal windows comes first
                doc, raw = docs[k], batch.column(1)[k].as_buffer().to_pybytes()
                for pos, g in sorted((x["pos"], x["g"]) for x in batch.column(2)[k].as_py()):
                    at, lo, hi = pos >> 16, pos >> 9 & 127, pos >> 2 & 127
                    if not pos & 2:
                        add(g, doc, pos, raw[at - lo:at - hi + LENGTH])
                        continue
                    run = []
                    for d in range(lo, hi - 1, -1):
                        own = raw[at - d:at - d + LENGTH]
                        if own in seen:
                            run.append(d)
                        else:
                            seen.add(own)
                            add(_key(own), doc, at << 16 | d << 9 | d << 2, own)
                    for first, last in _runs_down(run):
                        add(_key(b"%d %d" % (doc, pos)), doc, at << 16 | first << 9 | last << 2 | 1, b"")
                if len(out["key"]) >= 50_000:
                    yield _batch(out)
        if out["key"]:
            yield _batch(out)

    per_doc = unclear.groupBy("doc").agg(F.collect_list(F.struct("g", "pos")).alias("found"))
    return numbered.join(per_doc, "doc").select("doc", "text", "found").mapInArrow(each, "key long, doc long, pos long, bytes binary")


def _key(own: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)


def _runs_down(values: list[int]) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of falling neighbours."""
    runs: list[tuple[int, int]] = []
    for v in values:
        if runs and runs[-1][1] == v + 1:
            runs[-1] = runs[-1][0], v
        else:
            runs.append((v, v))
    return runs


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(out[k], pa.binary() if k == "bytes" else pa.int64()) for k in out], names=list(out))
    for v in out.values():
        v.clear()
    return batch


def _repeats(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, last start) of the runs of repeated windows among whole groups, rows in order of (key, doc, pos)."""
    if not len(key):
        return (np.empty(0, np.int64),) * 3
    at, lo, hi = pos >> 16, pos >> 9 & 127, pos >> 2 & 127
    _, wide = _ranks(data)
    many = lo - hi + 1
    start = ragged(np.cumsum(lens) - lens, many)
    row = np.repeat(np.arange(len(key)), many)
    ahead = lo[row] - (start - (np.cumsum(lens) - lens)[row])  # bytes from the window's start to the position
    rank = _join(wide[start], wide[start + LENGTH - 64])
    order = np.lexsort((row, rank, ahead, key[row]))
    k, r, d = key[row[order]], rank[order], ahead[order]
    again = np.zeros(len(order), bool)
    again[order[1:]] = (k[1:] == k[:-1]) & (r[1:] == r[:-1]) & (d[1:] == d[:-1])
    some = np.flatnonzero(again)
    if not len(some):
        return (np.empty(0, np.int64),) * 3
    new = np.flatnonzero(np.r_[True, (row[some][1:] != row[some][:-1]) | (some[1:] != some[:-1] + 1)])
    end = np.r_[new[1:], len(some)] - 1
    a, b = some[new], some[end]
    return doc[row[a]], at[row[a]] - ahead[a], at[row[b]] - ahead[b]


def shared_windows(near: DataFrame) -> DataFrame:
    """(doc, first, last) runs of window starts that repeat a window of an earlier row of the same key."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(rows: pa.Table) -> pa.RecordBatch:
            settled = rows["pos"].to_numpy() & 1 == 1
            done, rows = rows.filter(pa.array(settled)), rows.filter(pa.array(~settled))
            data, lens = _bytes_of(rows["bytes"].combine_chunks().cast(pa.large_binary()))
            found = _repeats(*(rows[c].to_numpy() for c in ("key", "doc", "pos")), data, lens)
            doc, pos = done["doc"].to_numpy(), done["pos"].to_numpy()
            at = pos >> 16
            runs = zip(found, (doc, at - (pos >> 9 & 127), at - (pos >> 2 & 127)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in runs], names=["doc", "first", "last"])

        for batch in batches:
            for part in slices(batch, "bytes", 4 << 20):
                rows = pa.Table.from_batches([*held, part])
                keys = rows["key"].to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if whole:
                    yield settle(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                else:
                    held = rows.to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    placed = near.repartition("key").sortWithinPartitions("key", "doc", "pos")
    return placed.mapInArrow(each, "doc long, first long, last long")


def _cut(raw: memoryview, spans: list[dict]) -> tuple[int, int, str]:
    """(removed bytes, maximal runs, hash of the rest) for runs of window starts."""
    kept, removed, runs, end = hashlib.sha256(), 0, 0, 0
    for a, b in sorted((s["first"], s["last"] + LENGTH) for s in spans):
        if a > end or not runs:
            runs += 1
            kept.update(raw[end:a])
            removed += b - a
        else:
            removed += max(0, b - end)
        end = max(end, b)
    kept.update(raw[end:])
    return removed, runs, kept.hexdigest()


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, text, doc_id): doc orders the documents; it is doc_id where that is a key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    n, known, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == known == distinct:
        return docs.select(F.col("doc_id").cast("long").alias("doc"), text, "doc_id")
    in_order = docs.select("doc_id", text).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return stored(in_order.select(F.monotonically_increasing_id().alias("doc"), "text", "doc_id"), "numbered-documents")


def _hot(numbered: DataFrame) -> list[int]:
    """16-byte ranks that stand in at least HOT_SHARE of a sample of documents."""
    every = max(1, numbered.select("doc").count() // SAMPLE_DOCS)
    sample = numbered.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0)
    held = positions(sample.select("doc", "text"), []).where("pos % 2 = 0").select("g", "doc").distinct().groupBy("g").count()
    return [r.g for r in held.where(F.col("count") >= max(20, HOT_SHARE * SAMPLE_DOCS)).collect()]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    numbered = _numbered(docs)
    texts = numbered.select("doc", "text")
    hot = F.col("pos").bitwiseAND(F.lit(2)) != 0
    ranked = positions(texts, _hot(numbered)).withColumn("spread", F.when(hot, F.col("c")).otherwise(F.lit(0).cast("long")))
    group, pair = Window.partitionBy("g", "spread"), Window.partitionBy("g", "spread", "c").orderBy("doc", "pos")
    judged = ranked.select("g", "doc", "pos", F.row_number().over(pair).alias("n"), (F.min("c").over(group) < F.max("c").over(group)).alias("mixed"))
    settled = F.col("pos").bitwiseAND(F.lit(1)) != 0
    repeat = settled | (F.col("n") > 1)
    found = stored(judged.where(repeat | hot | F.col("mixed")).select(F.when(~repeat, F.col("g")).alias("g"), "doc", "pos"), "judged-positions")
    at = F.shiftright("pos", 16)
    whole = found.where("g IS NULL").select("doc", (at - F.shiftright("pos", 9).bitwiseAND(F.lit(127))).alias("first"), (at - F.shiftright("pos", 2).bitwiseAND(F.lit(127))).alias("last"))
    single = stored(shared_windows(neighbourhoods(texts, found.where("g IS NOT NULL"))), "shared-windows")
    spans = whole.unionByName(single).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                rows.append((doc_id, len(raw), *_cut(memoryview(raw), own or [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema(list(zip(NAMES, TYPES))))

    return numbered.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
TYPES = [pa.int64()] * 4 + [pa.string()]
