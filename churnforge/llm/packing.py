"""Best-fit packing by the sum-of-squares rule.

A document becomes its ids and an end id; a longer one than a sequence is cut
into full pieces and a rest. Full pieces are sequences of their own. The other
pieces go, longest first, to the open sequence with room that makes the sum over
all residual gaps of (open sequences with that gap) squared smallest. A new one
is begun only where no open one has room, which with the longest pieces first
needs fewer sequences than beginning one whenever the sum asks for it. The choice
depends on counts by gap alone, so its state has one number per gap.

Scale: pieces are dealt at random to blocks of about ``BLOCK`` and each task
packs one block. A block leaves few sequences half empty, which is lost in a
block's tens of thousands.

Defined results: a null or empty text is the end id alone; an empty table gives no
rows; rows that share a doc_id are packed apart; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnforge.llm.common import slices, stored, texts_of
from churnforge.llm.tokens import encoder

BLOCK = 100_000


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids, on request)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                flat, n = encoder(tokenizer).encode(texts_of(part))
                ends = np.cumsum(n).tolist()
                cols = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc, a, b in zip(part.column(0).to_pylist(), [0, *ends[:-1]], ends):
                    ids = np.append(flat[a:b], end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), size)):
                        own = ids[at:at + size]
                        for name, v in zip(cols, (doc, k, at, len(own), zlib.crc32(own.tobytes()), own if with_ids else None)):
                            cols[name].append(v)
                if not with_ids:
                    del cols["ids"]
                yield pa.RecordBatch.from_pydict(cols, schema=pa.schema(
                    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece, placed longest first by the sum-of-squares rule."""
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, dtype=np.int64)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gaps = np.flatnonzero(count[s:size]) + s
        best = size
        if len(gaps):
            # moving a sequence from gap g to g - s changes the sum by 2 (N[g-s] - N[g] + 1); a full one is not counted
            after = np.where(gaps == s, 0, 2 * count[gaps - s] + 1)
            change = after - 2 * count[gaps] + 1
            best = int(gaps[np.argmin(change)])
        if best == size:
            at, made = made, made + 1
        else:
            at = open_by_gap[best].pop()
            count[best] -= 1
        sequence[i], offset[i] = at, size - best
        if best > s:
            open_by_gap[best - s].append(at)
            count[best - s] += 1
    return sequence, offset


def pack(pieces: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """Add sequence_id and offset to stored pieces (columns piece, length and whatever else)."""
    full, rest = pieces.where(F.col("length") == size), pieces.where(F.col("length") < size)
    blocks = max(1, -(-rest.count() // block))
    out = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sequence, offset = sum_of_squares(df["length"].to_numpy(), size)
        # even numbers; a block's own range cannot reach the next one's
        return df.drop(columns="block").assign(sequence_id=2 * (sequence + key[0] * (1 << 40)), offset=offset)

    dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(blocks)))
    packed = dealt.groupBy("block").applyInPandas(place, out)
    alone = full.withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and its place there."""
    return pack(stored(cut_pieces(docs, tokenizer, end_id, size, with_ids), "pieces"), size)
