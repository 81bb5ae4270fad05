"""Shared statistical primitives.

* ``value_counts_long`` – one unpivot + one partial/final hash aggregate gives
  per-column distinct counts, modes, tops, constants and class balance.
* ``group_mode`` – most frequent value per group, smallest on ties, computed as
  two partial aggregates (constant-size buffers, skew-safe).
* ``running_sum`` – distributed prefix sum: range-partition, running sums per
  slice, plus offsets of the preceding slices from a slice-sized table.
* ``exact_sums`` – sums of doubles with the same bits under any partitioning.
* ``exact_quantiles`` – linear-interpolation quantiles (pandas/NumPy default) by
  counting selection; no value is shuffled or sorted.
* ``hash_unit`` – stable pseudo-random number in [0, 100) from a key (splits).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def params_row(df: DataFrame, *aggs: Column) -> DataFrame:
    """One-row aggregate, meant to be attached back with ``with_params``."""
    return df.agg(*aggs)


def with_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Attach the columns of a one-row parameter frame to every row.

    Each column becomes an uncorrelated scalar subquery: Spark runs the
    one-row aggregate once (Catalyst merges the subqueries of one frame into
    a single job) and inlines the values as literals, so no join is planned.
    More than one row is an error, never a silent fan-out.
    """
    return df.select("*", *[params.select(F.col(f"`{c}`")).scalar().alias(c) for c in params.columns])


def value_counts_long(df: DataFrame, cols: list[str] | None = None, keep_null: bool = True) -> DataFrame:
    """(column, value, n) for every column, values cast to text, nulls kept as null."""
    cols = list(cols or df.columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value")
    if not keep_null:
        stacked = stacked.filter(F.col("value").isNotNull())
    return stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def group_mode(df: DataFrame, keys: list[str], col: str, alias: str | None = None,
               default: str | None = None) -> DataFrame:
    """Most frequent non-null value of ``col`` per key group; ties → smallest value."""
    counts = (df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n")))
    best = counts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_n")).alias("a"), F.col(col).alias("b"))).alias("_m"))
    out = best.select(*keys, F.col("_m.b").alias(alias or col))
    if default is not None:
        out = out.withColumn(alias or col, F.coalesce(F.col(alias or col), F.lit(default)))
    return out


def running_sum(df: DataFrame, order_col: str, value_cols: list[str], group_cols: list[str] = (),
                descending: bool = False, slices: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``value_cols`` ordered by ``order_col`` (unique per group).

    Rows are range-partitioned on (group, order) into slices; each slice is
    summed locally, and the totals of the preceding slices (a table with one
    row per slice and group) are added back through a broadcast join. No task
    holds more than one slice.

    The sliced table is checkpointed to the shared checkpoint folder: range
    bounds come from sampling, and a re-sample (recomputation, executor loss)
    could otherwise assign a row to different slices in the two branches.
    """
    group_cols = list(group_cols)
    spark = df.sparkSession
    if slices is None:
        slices = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    sliced = (df.repartitionByRange(slices, *[F.col(g) for g in group_cols], order)
              .withColumn("_slice", F.spark_partition_id())
              .checkpoint(eager=True))
    w_local = (Window.partitionBy("_slice", *group_cols).orderBy(order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = sliced.select("*", *[F.sum(v).over(w_local).alias(f"_loc_{v}") for v in value_cols])
    totals = sliced.groupBy("_slice", *group_cols).agg(*[F.sum(v).alias(f"_tot_{v}") for v in value_cols])
    w_off = (Window.partitionBy(*group_cols).orderBy("_slice")
             .rowsBetween(Window.unboundedPreceding, -1)) if group_cols else \
        Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", *group_cols, *[
        F.coalesce(F.sum(f"_tot_{v}").over(w_off), F.lit(0)).alias(f"_off_{v}") for v in value_cols])
    joined = local.join(F.broadcast(offsets), ["_slice", *group_cols], "inner")
    out = joined.select(*[c for c in df.columns], *[
        (F.col(f"_loc_{v}") + F.col(f"_off_{v}")).alias(f"{prefix}{v}") for v in value_cols])
    return out


DIGIT_BITS, DIGITS = 20, 5


def exact_sums(df: DataFrame, values: dict[str, Column], greatest: dict[str, float]) -> dict[str, float]:
    """Sums of doubles that do not depend on the order of addition, in one aggregate.

    With ``greatest`` (the largest absolute value of each) as the scale, a value is cut into ``DIGITS`` integers of
    ``DIGIT_BITS`` bits, largest first. Sums of integers are exact, so any partitioning gives the same bits; they hold for
    2**43 rows (more raise). A bit smaller than 2**-100 of the greatest value is cut off. Nulls do not count; values must be
    finite. The digits' sums are added from the smallest upwards.
    """
    units, aggs = {}, []
    for i, (name, value) in enumerate(values.items()):
        most = greatest.get(name) or 0.0
        if not most:
            continue
        # a power of two above all values, kept where all units are normal numbers
        top = max(math.frexp(most)[1], -900)
        units[name] = [math.ldexp(1.0, top - DIGIT_BITS * (k + 1)) for k in range(DIGITS)]
        rest = value
        for k, unit in enumerate(units[name]):
            digit = (rest / F.lit(unit)).cast("bigint")
            aggs.append(F.sum(digit).alias(f"d{i}_{k}"))
            rest = rest - digit * F.lit(unit)
    row = df.agg(*aggs).first() if aggs else None
    out = {}
    for i, name in enumerate(values):
        total = 0.0
        for k in reversed(range(DIGITS if name in units else 0)):
            total = float(row[f"d{i}_{k}"] or 0) * units[name][k] + total
        out[name] = total
    return out


BUCKETS = 4096
FEW_VALUES = 5000


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """(column, prob, quantile) with linear interpolation over non-null values.

    Equal to NumPy/pandas ``quantile`` (and SQL ``quantile_cont``), found by counting: one pass takes
    count, least and greatest value of every column; each further pass counts, for all
    wanted ranks at once, the values in ``BUCKETS`` equal parts of the interval that
    holds the rank, and goes on with the part that holds it. A part with one value is
    done, one with at most ``FEW_VALUES`` rows is read. No value is shuffled
    (only counts per part), no column is sorted, and the buffers do not grow with the input.
    Infinite values count as the greatest finite number of their sign.
    """
    spark, schema = df.sparkSession, "column string, prob double, quantile double"
    most = 1.7976931348623157e308
    value = {}
    for c in cols:
        v = F.col(f"`{c}`").cast("double")
        value[c] = F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.least(v, F.lit(most)), F.lit(-most)))
    if not cols:
        return spark.createDataFrame([], schema)
    row = df.agg(*[f(value[c]).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    at = {}  # (column, rank) -> value
    open_ranks = {}  # (column, lo, hi, values below) -> ranks inside
    wanted = []
    for i, c in enumerate(cols):
        n, lo, hi = row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]
        for p in probs if n else []:
            h = (n - 1) * p
            r1, r2 = math.floor(h), math.ceil(h)
            wanted.append((c, float(p), r1, r2, h - r1))
            if lo == hi:
                at[c, r1] = at[c, r2] = lo
            else:
                open_ranks.setdefault((c, lo, hi, 0, n), set()).update((r1, r2))
    while open_ranks:
        spans = list(open_ranks)
        used = list(dict.fromkeys(x[0] for x in spans))
        wide = df.select(*[value[c].alias(f"v{k}") for k, c in enumerate(used)])
        inside = wide.mapInArrow(_part_counts([(used.index(c), lo, hi, n <= FEW_VALUES) for c, lo, hi, _, n in spans]),
                                 "span int, part double, n long, lo double, hi double")
        counts = inside.groupBy("span", "part").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        by_span: dict[int, list] = {}
        for r in counts:
            by_span.setdefault(r["span"], []).append(r)
        following = {}
        for j, span in enumerate(spans):
            below, todo = span[3], sorted(open_ranks[span])
            for r in sorted(by_span.get(j, []), key=lambda r: r["part"]):
                own = [k for k in todo if below <= k < below + r["n"]]
                if own and r["lo"] == r["hi"]:
                    at.update({(span[0], k): r["lo"] for k in own})
                elif own:
                    following[span[0], r["lo"], r["hi"], below, r["n"]] = set(own)
                below += r["n"]
        open_ranks = following
    out = [(c, p, at[c, r1] + (at[c, r2] - at[c, r1]) * part) for c, p, r1, r2, part in wanted]
    return spark.createDataFrame(out, schema)


def _part_counts(spans: list[tuple[int, float, float, bool]]):
    """The task's function of a counting pass: (span, part, count, least, greatest) of the values in every part of (column, lo, hi, few)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(spans), BUCKETS), np.int64)
        least, most = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        held: dict[int, list[np.ndarray]] = {j: [] for j, x in enumerate(spans) if x[3]}
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
            for j, (k, lo, hi, few) in enumerate(spans):
                v = columns[k]
                v = v[(v >= lo) & (v <= hi)]  # a missing value is NaN and in no interval
                if few:
                    held[j].append(v)
                    continue
                # halves, as the width of the widest interval overflows; the part never falls as v grows
                width = hi / 2 - lo / 2
                at = np.minimum((v / 2 - lo / 2) / width * BUCKETS, BUCKETS - 1).astype(np.int64) if width else (v > lo).astype(np.int64)
                n[j] += np.bincount(at, minlength=BUCKETS)
                np.minimum.at(least[j], at, v)
                np.maximum.at(most[j], at, v)
        span, part = np.nonzero(n)
        rows = [(span, part.astype(np.float64), n[span, part], least[span, part], most[span, part])]
        for j, found in held.items():
            v, own = np.unique(np.concatenate([np.empty(0), *found]), return_counts=True)
            rows.append((np.full(len(v), j), v, own, v, v))
        span, part, own, lo, hi = (np.concatenate(c) for c in zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(span.astype(np.int32)), pa.array(part), pa.array(own.astype(np.int64)), pa.array(lo), pa.array(hi)],
                                         names=["span", "part", "n", "lo", "hi"])

    return count


def quantile_map(df: DataFrame, cols: list[str], probs: list[float]) -> dict[tuple[str, float], float]:
    """Collect the (column × prob)-sized quantile table as driver parameters."""
    if not cols:
        return {}
    return {(r["column"], r["prob"]): r["quantile"] for r in exact_quantiles(df, cols, probs).collect()}


def spread(df: DataFrame) -> DataFrame:
    """A stored narrow table over at least as many partitions as there are cores: work on its rows, not its bytes, takes the time."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores).checkpoint(eager=True)


def hash_unit(key: Column, seed: int = 42) -> Column:
    """Deterministic value in [0, 100) from a key: stable splits and samples."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 100


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
