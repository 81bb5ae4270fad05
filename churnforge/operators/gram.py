"""Pearson correlations of all pairs of many columns from one Gram aggregate with a mask for missing values.

A task adds, batch by batch, the products Z'Z, Z'M and (Z*Z)'M of its centred values Z and its
mask M of present ones; these are the sums of every pair over the rows where both are present. A task leaves one
row per pair, and Spark adds them. Values are centred by their mean and scaled by their range, from one aggregate of
all rows before, so that the sums lose no digits; a pair whose common rows lie far from the centre for their spread is
taken again by Spark's own moments.

More than ``BLOCK`` columns are cut into blocks, and every two blocks are one such pass over their
columns alone, so a task holds at most (2 x BLOCK)^2 sums.

Defined results: null and NaN are missing; a pair without two different values in both columns
over its common rows, or with an infinite value there, has a null r; an empty table gives null for all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions import exprs as X
from churnforge.operators.stats import union_all
from churnforge.session import checkpoint_dir

BLOCK = 512
# Sums of squares lose digits where the spread of a pair's rows is below this share of their distance from the centre.
DOUBTFUL = 1e-6
AGAIN = 40  # doubtful pairs in one aggregate
SUMS = ("n", "odd", "sx", "sy", "sxx", "syy", "sxy")
SCHEMA = "i int, j int, " + ", ".join(f"{c} double" for c in SUMS)


def pair_moments(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(covariance, variance of x, variance of y) over the rows where both are present."""
    both = x.isNotNull() & y.isNotNull()
    xa, ya = F.when(both, x), F.when(both, y)
    return F.covar_pop(xa, ya), F.var_pop(xa), F.var_pop(ya)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) for every two columns, a before b in the order of ``cols``."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    value = {c: X.nan_to_null(F.col(f"`{c}`").cast("double")) for c in cols}
    finite = {c: F.when(F.abs(v) < float("inf"), v) for c, v in value.items()}
    row = df.agg(*[f(finite[c]).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))]).first()
    least, most, mean = (np.array([row[f"{n}{i}"] or 0.0 for i in range(len(cols))]) for n in ("lo", "hi", "m"))
    centre = np.where(least == most, least, mean)  # a constant column is exactly 0, whatever the mean's last digit
    scale = np.where(least == most, 1.0, most / 2 - least / 2)
    blocks = [list(range(a, min(a + BLOCK, len(cols)))) for a in range(0, len(cols), BLOCK)]
    passes = [(p, q) for b, q in enumerate(blocks) for p in blocks[:b + 1]]
    parts = []
    for p, q in passes:
        own = p if p is q else p + q
        plain = df.select(*[value[cols[k]].alias(f"v{k}") for k in own])
        parts.append(plain.mapInArrow(_adder(np.array(own), centre[own], scale[own], 0 if p is q else len(p)), SCHEMA))
    sums = union_all(parts).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])
    pairs = _pairs(spark, cols)
    mean_x, mean_y = F.try_divide("sx", "n"), F.try_divide("sy", "n")
    vx, vy = F.try_divide("sxx", "n") - mean_x * mean_x, F.try_divide("syy", "n") - mean_y * mean_y
    cov = F.try_divide("sxy", "n") - mean_x * mean_y
    doubtful = (F.col("sxx") > 0) & (F.col("syy") > 0) & ((vx <= DOUBTFUL * mean_x * mean_x) | (vy <= DOUBTFUL * mean_y * mean_y))
    found = pairs.join(sums, ["i", "j"], "left").select(
        "i", "j", "a", "b",
        F.when(F.col("odd") > 0, None).otherwise(F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))).alias("r"),
        F.coalesce((F.col("odd") == 0) & doubtful, F.lit(False)).alias("again")).checkpoint()
    pending = found.where("again").select("a", "b").collect()
    if not pending:
        return found.select("a", "b", "r")
    rows = []
    for at in range(0, len(pending), AGAIN):
        some = pending[at:at + AGAIN]
        got = df.agg(*[m.alias(f"{kind}{k}") for k, p in enumerate(some) for kind, m in zip("cxy", pair_moments(value[p["a"]], value[p["b"]]))]).first()
        for k, p in enumerate(some):
            c, x, y = got[f"c{k}"], got[f"x{k}"], got[f"y{k}"]
            rows.append((p["a"], p["b"], c / (x * y) ** 0.5 if x and y and x * y > 0 else None))
    settled = spark.createDataFrame(rows, "a string, b string, exact double")
    return found.join(settled, ["a", "b"], "left").select("a", "b", F.when(F.col("again"), F.col("exact")).otherwise(F.col("r")).alias("r"))


def _pairs(spark: SparkSession, cols: list[str]) -> DataFrame:
    """(i, j, a, b) of every two columns, i < j."""
    names = F.array(*[F.lit(c) for c in cols])
    j = spark.range(len(cols)).select(F.col("id").cast("int").alias("j")).where("j > 0")
    return j.select("j", F.explode(F.sequence(F.lit(0), F.col("j") - 1)).alias("i")).select(
        "i", "j", F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"))


def _adder(number: np.ndarray, centre: np.ndarray, scale: np.ndarray, border: int):
    """The task's function: sums of all pairs of its columns, or of those on both sides of ``border``."""
    size = len(number)
    left, right = np.triu_indices(size, 1)
    if border:
        across = (left < border) & (right >= border)
        left, right = left[across], right[across]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, odd, s, q, c = (np.zeros((size, size)) for _ in range(5))
        for batch in batches:
            raw = np.stack([v.to_numpy(zero_copy_only=False).astype(np.float64) for v in batch.columns], 1)
            there = ~np.isnan(raw)
            endless = np.isinf(raw)
            z = (np.where(there & ~endless, raw, centre) - centre) / scale
            m = there.astype(np.float64)
            if there.all():
                n += len(z)
                s += z.sum(0)[:, None]
                q += (z * z).sum(0)[:, None]
            else:
                n += m.T @ m
                s += z.T @ m
                q += (z * z).T @ m
            c += z.T @ z
            if endless.any():
                meets = endless.astype(np.float64).T @ m
                odd += meets + meets.T
        columns = [n[left, right], odd[left, right], s[left, right], s[right, left], q[left, right], q[right, left], c[left, right]]
        yield pa.RecordBatch.from_arrays([pa.array(number[left], pa.int32()), pa.array(number[right], pa.int32()), *map(pa.array, columns)], names=["i", "j", *SUMS])

    return add
