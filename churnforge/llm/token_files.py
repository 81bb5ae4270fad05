"""Token-id files with Elias-Fano document boundaries.

``write_token_files`` sorts documents by id, encodes whole texts and lets each
task write one file: a plain array of ids (16 or 32 bits wide), followed by an
Elias-Fano code of the document ends and one of the document ids. A monotone
sequence of n values below u takes about 2 + log2(u / n) bits a value; a sampled
select structure (the place of every 256th set bit) finds any boundary without
a table of offsets. ``read_token_files`` opens the files again and returns one
row per document.

Defined results: a null text is an empty document (it has the end id alone); an
empty table gives no files and no rows; rows that share a doc_id stay apart
and lie next to each other; null doc_ids come first; columns other than doc_id
and text are ignored, so their names cannot clash. Tasks write under a name of
their own and the table of files lists only what committed tasks wrote, so a
repeated or speculative task leaves at most an unused file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from churnforge.llm.common import open_uri, slices, stored, texts_of
from churnforge.llm.tokens import encoder
from churnforge.session import scratch_path

MAGIC = b"EFIDS\x00\x01\x00"
SAMPLE = 256  # set bits between two entries of the select structure
READ_IDS = 4 << 20  # ids read at a time


class EliasFano:
    """A monotone sequence of non-negative integers with access by index.

    ``low`` holds the lower bits of all values side by side, ``high`` the upper
    parts in unary (value i sets bit (v >> width) + i), ``every`` the place of
    each SAMPLE-th set bit.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, every: np.ndarray):
        self.n, self.width, self.low, self.high, self.every = n, width, low, high, every

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint64))
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(width, dtype=np.uint64)
        low = [np.packbits(((values[a:a + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
               for a in range(0, n, 65536)]  # 65536 values fill whole bytes at any width
        place = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(int(place[-1]) + 1, dtype=np.uint8)
        bits[place] = 1
        return cls(n, width, np.concatenate(low), np.packbits(bits, bitorder="little"), place[::SAMPLE])

    def span(self, a: int, b: int) -> np.ndarray:
        """Values a..b-1, found by select from the nearest sampled bit."""
        if b <= a:
            return np.empty(0, dtype=np.int64)
        first = a // SAMPLE
        from_bit = int(self.every[first])
        last = -(-b // SAMPLE)
        to_byte = len(self.high) if last >= len(self.every) else int(self.every[last]) // 8 + 1
        bits = np.unpackbits(self.high[from_bit // 8:to_byte], bitorder="little")
        bits[:from_bit % 8] = 0
        place = np.flatnonzero(bits)[a - first * SAMPLE:b - first * SAMPLE] + from_bit // 8 * 8
        upper = place - np.arange(a, b)
        if not self.width:
            return upper
        at = a * self.width
        low = np.unpackbits(self.low[at // 8:-(-b * self.width // 8)], bitorder="little")[at % 8:at % 8 + (b - a) * self.width]
        weights = np.int64(1) << np.arange(self.width, dtype=np.int64)
        return (upper << self.width) + low.reshape(b - a, self.width).astype(np.int64) @ weights

    def __getitem__(self, i: int) -> int:
        return int(self.span(i, i + 1)[0])

    def write(self, out) -> None:
        out.write(struct.pack("<5q", self.n, self.width, len(self.low), len(self.high), len(self.every)))
        # a sampled place needs no more bits than the unary array is long
        wide = "<u4" if 8 * len(self.high) < 1 << 32 else "<u8"
        for part in (self.low, self.high, self.every.astype(wide)):
            out.write(part.tobytes())

    @classmethod
    def read(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        n, width, low, high, every = struct.unpack_from("<5q", data)
        wide = "<u4" if 8 * high < 1 << 32 else "<u8"
        a, b = 40, 40 + low
        c = b + high
        d = c + every * int(wide[2])
        return cls(n, width, np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[b:c], np.uint8),
                   np.frombuffer(data[c:d], wide)), data[d:]


class TokenFile:
    """A file of ``write_token_files``: documents by position, ids by document."""

    def __init__(self, path: str):
        fs, inner = open_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        tail = struct.unpack("<q", self.file.read_at(8, size - 8))[0]
        foot = memoryview(self.file.read_at(tail, size - 8 - tail))
        magic, width, self.nulls, self.least = struct.unpack_from("<8s3q", foot)
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.type = np.dtype(f"<u{width}")
        self.ends, foot = EliasFano.read(foot[32:])
        self.ids, _ = EliasFano.read(foot)

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        known = self.ids.span(max(a, self.nulls) - self.nulls, max(b, self.nulls) - self.nulls) + self.least
        return [None] * (min(b, self.nulls) - min(a, self.nulls)) + known.tolist()

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Places of the first id of documents a..b-1, and the end of the last."""
        return np.r_[0, self.ends.span(0, b)] if a == 0 else self.ends.span(a - 1, b)

    def tokens(self, start: int, end: int) -> np.ndarray:
        w = self.type.itemsize
        return np.frombuffer(self.file.read_at((end - start) * w, start * w), self.type)

    def document(self, i: int) -> np.ndarray:
        b = self.bounds(i, i + 1)
        return self.tokens(int(b[0]), int(b[1]))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_bytes: int = 2) -> DataFrame:
    """Write ``docs(doc_id, text)`` as token files; returns the stored table of files.

    Columns: path, shard (ascending with doc_id), n_docs, n_ids. ``id_bytes`` is
    2 where all ids are below 65536, else 4; a larger id raises.
    """
    folder = folder or scratch_path(docs.sparkSession, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, inner = open_uri(folder)
        path, out, n_ids, ends, ids = "", None, 0, [], []
        limit = 1 << (8 * id_bytes)
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    fs.create_dir(inner, recursive=True)
                    name = f"ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    path, out = f"{folder}/{name}", fs.open_output_stream(f"{inner}/{name}")
                flat, size = encoder(tokenizer).encode(texts_of(part))
                last = np.cumsum(size + 1)
                whole = np.full(int(last[-1]), end_id, dtype=np.int64)
                keep = np.ones(len(whole), dtype=bool)
                keep[last - 1] = False
                whole[keep] = flat
                if whole.max() >= limit:
                    raise ValueError(f"id {whole.max()} does not fit {id_bytes} bytes")
                out.write(whole.astype(f"<u{id_bytes}").tobytes())
                ends.append(n_ids + last)
                ids += part.column(0).to_pylist()
                n_ids += len(whole)
        if out is None:
            return
        nulls = sum(i is None for i in ids)
        known = np.array(ids[nulls:], dtype=np.int64)
        least = int(known[0]) if len(known) else 0
        at = out.tell()
        out.write(struct.pack("<8s3q", MAGIC, id_bytes, nulls, least))
        EliasFano.of(np.concatenate(ends)).write(out)
        EliasFano.of(known - least).write(out)
        out.write(struct.pack("<q", out.tell() - at))
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "shard": [TaskContext.get().partitionId()], "n_docs": [len(ids)], "n_ids": [n_ids]})

    in_order = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = in_order.mapInArrow(write, "path string, shard long, n_docs long, n_ids long")
    return stored(files, "token-file-list")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the listed files.

    doc_id, start (ids of all documents before it, over all files), n_tokens,
    ids_crc32 (unsigned crc32 of its ids as little-endian 32-bit integers), path,
    place (its number within the file). Files are read in runs of whole documents.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f, a = TokenFile(row["path"]), 0
                per = max(1, READ_IDS * len(f) // max(1, row["n_ids"]))
                while a < len(f):
                    b = min(a + per, len(f))
                    ends = f.bounds(a, b)
                    ids = f.tokens(int(ends[0]), int(ends[-1])).astype("<u4")
                    at = (ends - ends[0]).tolist()
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(f.doc_ids(a, b), pa.int64()), "start": pa.array(ends[:-1] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(ends), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at[:-1], at[1:])], pa.int64()),
                        "path": pa.array([row["path"]] * (b - a)), "place": pa.array(range(a, b), pa.int64())})
                    a = b

    # one row per file: as many as writing tasks, so the running total is a small window
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = based.repartition(max(1, min(files.count(), 10_000)))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, place long")
