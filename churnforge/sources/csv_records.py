"""CSV records with line breaks inside quoted fields, read from any byte range of a file.

Spark's text reader cuts files into byte ranges and gives whole lines, in order, with their file and range. Whether a
line begins inside a quoted field depends on all lines before it, but only through one bit. A first pass
computes for every range how it ends for both beginnings; these maps are composed from range to range, which gives the
true beginning of each. A second pass joins lines into records. A record that runs over the end of its
range is put together from its pieces by a grouping, so that only such records are shuffled.

Fields are quoted with ``"``, which is doubled inside them; a quote inside an unquoted field is text. Records end
with a line feed, with or without a carriage return before it; breaks inside a field stay as they are. The first
record of each file names the columns (those of the first file by name count) and blank records are skipped. A field left open at the end of a file ends there.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IN_QUOTES = re.compile(r'(?:[^"]++|"")*+')
TO_COMMA = re.compile(r"[^,]*+")
# whole fields, each with its comma, and then a field that is opened and not closed
OPEN_AT_END = re.compile(r'(?:(?:"(?:[^"]++|"")*+"(?!")[^,]*+|[^",][^,]*+|),)*+"(?:[^"]++|"")*+\Z')
BOM = "﻿"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, for a beginning inside or outside of one."""
    at = 0
    if inside:
        at = IN_QUOTES.match(line).end()
        if at == len(line):
            return True
        at = TO_COMMA.match(line, at + 1).end()
        if at == len(line):
            return False
        at += 1
    return OPEN_AT_END.match(line, at) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start of its byte range, line), lines of a range in order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], list[str], list[bool]]]:
    """(range, its lines, which of them have a quote) for every run of lines of one range."""
    file, start = (batch.column(k).to_numpy() for k in (0, 1))
    quoted = pc.match_substring(batch.column(2), '"').to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield (int(file[a]), int(start[a])), batch.column(2).slice(a, b - a).to_pylist(), quoted[a:b].tolist()


def _range_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, out, in): how each range ends when it begins outside and inside of a field."""
    maps: dict[tuple[int, int], list[bool]] = {}
    for batch in batches:
        for key, lines, quoted in _runs(batch):
            state = maps.setdefault(key, [False, True])
            for line in (x for x, q in zip(lines, quoted) if q):
                state[0], state[1] = ends_inside(line, state[0]), ends_inside(line, state[1])
    if maps:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*k, *v) for k, v in maps.items()]), (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))],
                                         ["file", "start", "out", "in"])


PIECE = "file long, start long, part int, first boolean, whole boolean, ends boolean, record string"


def _join_lines(begin_inside: set[tuple[int, int]]):
    """Lines to records; pieces of records that run over a range's end are marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, inside, opened, first = None, [], False, False, False
        out: list[tuple] = []

        def rest() -> None:
            # what is left of a range: the beginning of a record, or a range within one field
            if key is not None and held:
                out.append((*key, 1 if not opened else 0, first, False, False, "\n".join(held)))

        def ready() -> pa.RecordBatch:
            cols = zip(*out) if out else [()] * 7
            types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["file", "start", "part", "first", "whole", "ends", "record"])

        for batch in batches:
            for at, lines, quoted in _runs(batch):
                if at != key:
                    rest()
                    inside = at in begin_inside
                    key, held, opened, first = at, [], inside, at[1] == 0 and not inside
                for line, q in zip(lines, quoted):
                    held.append(line)
                    inside = ends_inside(line, inside) if q else inside
                    if not inside:
                        out.append((*key, 0, first, not opened, True, "\n".join(held)))
                        held, opened, first = [], False, False
            if out:
                yield ready()
                out.clear()
        rest()
        if out:
            yield ready()

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): all records of the files under ``path``; ``first`` marks the header of a file."""
    lines = _lines(spark, path)
    maps = {(r["file"], r["start"]): (r["out"], r["in"]) for r in lines.mapInArrow(_range_maps, "file long, start long, out boolean, in boolean")
            .groupBy("file", "start").agg(F.first("out").alias("out"), F.first("in").alias("in")).collect()}  # one row for each byte range
    begin_inside, state, file = set(), False, None
    for key in sorted(maps):
        state = state and key[0] == file
        if state:
            begin_inside.add(key)
        state, file = maps[key][state], key[0]
    pieces = lines.mapInArrow(_join_lines(begin_inside), PIECE)
    whole = pieces.where("whole").select("file", "first", "record")
    if not begin_inside and not state:
        return pieces.select("file", "first", "record")
    # pieces of one record lie between two ends of records
    listed = pieces.where(~F.col("whole"))
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = listed.withColumn("number", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)))
    joined = numbered.groupBy("file", "number").agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "part", "record"))).alias("p"))
    return whole.unionByName(joined.select("file", "first", F.array_join("p.record", "\n").alias("record")))


def column_names(header: str) -> list[str]:
    """Names of the columns; an empty one is named by its place, a repeated one gets its place behind it."""
    row = next(csv.reader([header.removeprefix(BOM).removesuffix("\r")]), [])
    folded = [n.lower() for n in row]
    return [f"_c{i}" if not n else f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(row)]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a record with too few fields has nulls, further fields are left out."""
    rows = records(spark, path)
    listed = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("name"))
    by_name = rows.where("first").join(listed, "file")
    head = by_name.orderBy("name").select("record").first()
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    names = column_names(head["record"])
    body = rows.where(~F.col("first")).select(F.regexp_replace("record", "\r$", "").alias("record")).where(F.trim("record") != "")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "maxCharsPerColumn": "-1",
               "lineSep": "\u0001"}
    return body.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select(
        *[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
