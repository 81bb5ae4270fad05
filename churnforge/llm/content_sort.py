"""Exact de-duplication by a content sort.

Rows are range-partitioned by sampled splitters over (first bytes, hash of the
body, doc_id) and sorted inside partitions by (first bytes, hash, body, doc_id
descending), so that equal bodies are neighbours, and neighbours are compared in
full. The splitters hold no more than ``HEAD`` bytes of a body, and doc_id is one of
the keys, so a group of copies of any size is spread over partitions. A run of
equal bodies may go on in the next partition: the first and last run of every
partition (two small rows each) are brought together by their whole bodies.

Defined results: null texts equal empty ones; a null doc_id is smaller than all
others; of rows that share text and doc_id exactly one is kept; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from churnforge.llm.common import stored

HEAD = 32
RUNS = "doc_id long, text_sha256 string, first_id long, run_size long, first boolean, part int, edge int, body binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, body) to rows of their runs; the body goes along once for the runs at both ends."""
    from pyspark import TaskContext

    part, body, ids, first_run, ready = TaskContext.get().partitionId(), None, [], True, []
    names = [x.split()[0] for x in RUNS.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()))))

    def close(last: bool) -> None:
        edge = 1 if first_run else 2 if last else 0
        sha, n = hashlib.sha256(body).hexdigest(), len(ids)
        ready.extend((i, sha, ids[0], n, not k, part, edge, body.to_pybytes() if edge and not k else None) for k, i in enumerate(ids))

    def out() -> pa.RecordBatch:
        cols = list(zip(*ready))
        ready.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    for batch in batches:
        for i, b in zip(batch.column(0).to_pylist(), batch.column(1)):
            b = b.as_buffer()
            if body is not None and b.equals(body):
                ids.append(i)
                continue
            if body is not None:
                close(False)
                first_run = False
                if len(ready) >= 10_000:
                    yield out()
            body, ids = pa.py_buffer(b.to_pybytes()), [i]
    if body is not None:
        close(True)
        yield out()


def content_sort_dedup(docs: DataFrame, normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to the form that is compared; the largest
    doc_id of equal forms is kept.
    """
    rows = docs.select("doc_id", normalise(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary").alias("body"))
    keyed = rows.select("doc_id", "body", F.substring("body", 1, HEAD).alias("head"), F.xxhash64("body").alias("hash"))
    placed = keyed.repartitionByRange("head", "hash", F.col("doc_id").desc())
    in_order = placed.sortWithinPartitions("head", "hash", "body", F.col("doc_id").desc())
    runs = stored(in_order.select("doc_id", "body").mapInArrow(_runs, RUNS), "content-runs")
    # at most two runs per partition: the groups they form are no larger than the list of partitions
    ends = runs.where(F.col("body").isNotNull()).select("part", "edge", "first_id", "run_size", "body")
    groups = ends.groupBy("body").agg(
        F.max("first_id").alias("keep_id"), F.sum("run_size").alias("group_size"),
        F.max(F.struct("first_id", -F.col("part"), -F.col("edge"))).alias("winner"), F.collect_list(F.struct("part", "edge")).alias("of"))
    stitched = groups.select("keep_id", "group_size", F.struct(-F.col("winner.col2"), -F.col("winner.col3")).alias("winner"), F.explode("of").alias("at")).select(
        F.col("at.part").alias("part"), F.col("at.edge").alias("edge"), "keep_id", "group_size",
        ((F.col("winner.col1") == F.col("at.part")) & (F.col("winner.col2") == F.col("at.edge"))).alias("wins"))
    joined = runs.drop("body").join(F.broadcast(stitched), ["part", "edge"], "left")
    return joined.select(
        "doc_id", F.when(F.col("wins").isNull(), F.col("first_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "run_size").alias("group_size"),
        (F.col("first") & F.coalesce("wins", F.lit(True))).alias("kept"), "text_sha256")
