"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from churnforge.session import scratch_path

# Texts are worked on in slices of about so many bytes, whatever the Arrow batch holds.
SLICE_BYTES = 8 << 20
BATCH_ROWS = 4_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let whole texts travel between the executor and its Python workers in batches of bounded bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SLICE_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage with files every executor sees, so that later stages
    survive lost executors and no branch computes ``df`` twice. The shuffle files behind
    ``df`` are of no more use then; Spark deletes them when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``most`` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    part = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a Python worker for later stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The text column with nulls as empty strings."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs [start, start + len), run after run."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total, dtype=np.int64)


def open_uri(path: str):
    """(file system, path in it) for a folder named like spark.checkpoint.dir."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)
