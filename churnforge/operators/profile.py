"""Profiling / EDA operators: summary, describe, missing counts, correlation,
histograms, box statistics, class balance, churn rate by category, KDE.

They run unchanged on any table (subscribers, customer, orders, lineitem,
events). Per-column numbers come from one wide aggregate plus distributed
quantiles; only one row per column ever reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from churnforge.functions import exprs as X
from churnforge.operators import clean as C
from churnforge.operators.quality import correlation_frame
from churnforge.operators.stats import exact_quantiles, exact_sums, value_counts_long


def _q(c: str) -> F.Column:
    return F.col(f"`{c}`")


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric/text column counts, blank-aware missing cells, duplicate rows."""
    blanked = C.blank_to_null(df)
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    missing = sum(C.null_counts(blanked).values()) if df.columns else 0
    rows = df.count()
    dups = rows - df.dropDuplicates().count()
    return df.sparkSession.createDataFrame(
        [(rows, len(df.columns), len(nums), len(df.columns) - len(nums), missing, dups)],
        "Number_of_Rows bigint, Number_of_Columns int, Numerical_Features int, Categorical_Features int, "
        "Missing_Values bigint, Duplicate_Rows bigint")


def preview(df: DataFrame, n: int = 100, key: str | None = None) -> DataFrame:
    """First ``n`` rows, ordered by ``key`` (default: first column) for determinism."""
    key = key or df.columns[0]
    return df.orderBy(_q(key)).limit(n)


def schema_table(df: DataFrame) -> DataFrame:
    """Column, type and number of non-null values, from one aggregate."""
    row = df.agg(*[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.sparkSession.createDataFrame([(c, t, row[f"n{i}"]) for i, (c, t) in enumerate(df.dtypes)],
                                           "column string, type string, non_null bigint")


def missing_by_column(df: DataFrame) -> DataFrame:
    """Null (blank-aware) count per column, long form, from one aggregate."""
    blanked = C.blank_to_null(df)
    counts = C.null_counts(blanked)
    return df.sparkSession.createDataFrame([(i, c, counts[c]) for i, c in enumerate(df.columns)],
                                           "position int, column string, missing bigint")


def describe_all(df: DataFrame) -> DataFrame:
    """Every column: count/mean/std/min/quartiles/max for numbers, count/unique/top/freq and least/greatest for all other types.

    Means and deviations come from sums that do not depend on the order of addition; an infinite value
    makes both null.
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    nums = [c for c in df.columns if isinstance(types[c], NumericType)]
    others = [c for c in df.columns if c not in nums]
    aggs = []
    for i, c in enumerate(df.columns):
        v = X.nan_to_null(_q(c).cast("double")) if c in nums else _q(c)
        aggs.append(F.count(v).alias(f"n{i}"))
        if c in nums:
            aggs += [F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
        else:
            aggs += [F.min(v.cast("string")).alias(f"min{i}"), F.max(v.cast("string")).alias(f"max{i}")]
    row = df.agg(*aggs).first()
    mean, std = _moments(df, {c: (row[f"n{i}"], row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(df.columns) if c in nums})
    quarts = {}
    for r in exact_quantiles(df, nums, [0.25, 0.5, 0.75]).collect() if nums else []:
        quarts[(r["column"], r["prob"])] = r["quantile"]
    tops = {}
    if others:
        counts = value_counts_long(df, others, keep_null=False)
        stat = counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("m"))
        tops = {r["column"]: (r["unique"], r["m"]["b"], -r["m"]["a"]) for r in stat.collect()}
    out = []
    for i, c in enumerate(df.columns):
        if c in nums:
            out.append((c, row[f"n{i}"], None, None, None, mean.get(c), std.get(c), row[f"min{i}"],
                        quarts.get((c, 0.25)), quarts.get((c, 0.5)), quarts.get((c, 0.75)), row[f"max{i}"], None, None))
        else:
            out.append((c, row[f"n{i}"], *tops.get(c, (0, None, None)), *[None] * 7, row[f"min{i}"], row[f"max{i}"]))
    return spark.createDataFrame(out, "column string, count bigint, unique bigint, top string, freq bigint, "
                                      "mean double, std double, min double, q1 double, median double, q3 double, "
                                      "max double, least string, greatest string")


def _moments(df: DataFrame, known: dict[str, tuple]) -> tuple[dict[str, float], dict[str, float]]:
    """Means and sample deviations of columns with known (count, least, greatest): one pass for the sums, one for the squares about the mean."""
    known = {c: k for c, k in known.items() if k[0] and math.isfinite(k[1]) and math.isfinite(k[2])}
    value = {c: X.nan_to_null(_q(c).cast("double")) for c in known}
    sums = exact_sums(df, value, {c: max(abs(lo), abs(hi)) for c, (_, lo, hi) in known.items()})
    mean = {c: sums[c] / n for c, (n, _, _) in known.items()}
    far = {c: max(hi - mean[c], mean[c] - lo) for c, (_, lo, hi) in known.items()}
    squares = {c: (value[c] - F.lit(mean[c])) * (value[c] - F.lit(mean[c])) for c in known}
    total = exact_sums(df, squares, {c: far[c] * far[c] * (1 + 1e-9) for c in known})
    return mean, {c: math.sqrt(total[c] / (n - 1)) for c, (n, _, _) in known.items() if n > 1}


def analysable_numeric(df: DataFrame) -> DataFrame:
    """Numeric columns plus text columns that parse as numbers for > 75% of rows."""
    repaired, _ = C.repair_types(C.blank_to_null(df), exempt=())
    return repaired.select(*[_q(f.name) for f in repaired.schema.fields if isinstance(f.dataType, NumericType)])


def corr_matrix(df: DataFrame) -> DataFrame:
    """Long (a, b, r), a before b in column order, pairwise-complete Pearson."""
    num = analysable_numeric(df)
    return correlation_frame(num, num.columns)


def missing_map_sample(df: DataFrame, n: int = 500, key: str | None = None, seed: int = 42) -> DataFrame:
    """A stable hash sample of ≤ n rows as 0/1 null flags, for drawing (``missing_patterns`` counts all rows)."""
    key = key or df.columns[0]
    blanked = C.blank_to_null(df)
    flags = [F.when(_q(c).isNull(), 1).otherwise(0).alias(c) for c in df.columns if c != key]
    return blanked.orderBy(F.xxhash64(F.lit(seed), _q(key)), _q(key)).limit(n).select(_q(key), *flags)


def missing_patterns(df: DataFrame) -> DataFrame:
    """Rows per null pattern (blank-aware): one 0/1 flag per column and the number of rows that have it.

    The complete form of a missing-value map; as many rows as there are patterns.
    """
    blanked = C.blank_to_null(df)
    flags = [F.when(_q(c).isNull(), 1).otherwise(0).alias(c) for c in df.columns]
    return blanked.select(*flags).groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("Rows"))


def _numeric(df: DataFrame, columns: list[str] | None) -> list[str]:
    return list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)])


def histograms(df: DataFrame, bins: int = 30, columns: list[str] | None = None) -> DataFrame:
    """Equal-width histograms of all numeric columns (or ``columns``), long form.

    One pass for the ranges, one for the counts; the ranges are one row per column.
    """
    cols = _numeric(df, columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, Bin int, Bin_Start double, Bin_End double, Count bigint")
    v = {c: X.nan_to_null(_q(c).cast("double")) for c in cols}
    row = df.agg(*[f(v[c]).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ranges = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols) if row[f"lo{i}"] is not None}

    def bin_of(c):
        lo, hi = ranges[c]
        at = F.floor((v[c] - F.lit(lo)) * bins / F.lit(hi - lo)) if hi > lo else F.lit(0)
        return F.when(v[c].isNotNull(), F.least(at, F.lit(bins - 1)).cast("int"))
    if not ranges:
        return df.sparkSession.createDataFrame([], "column string, Bin int, Bin_Start double, Bin_End double, Count bigint")
    binned = df.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), bin_of(c).alias("Bin"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for c, (lo, hi) in ranges.items()])))
    width = F.col("hi") - F.col("lo")
    return (binned.filter(F.col("Bin").isNotNull()).groupBy("column", "Bin", "lo", "hi").agg(F.count(F.lit(1)).alias("Count"))
            .select("column", "Bin", (F.col("lo") + F.col("Bin") * width / bins).alias("Bin_Start"),
                    (F.col("lo") + (F.col("Bin") + 1) * width / bins).alias("Bin_End"), "Count"))


def box_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """q1/median/q3, whiskers (extreme values inside 1.5·iqr) and outlier counts of all numeric columns."""
    cols = _numeric(df, columns)
    schema = ("column string, q1 double, median double, q3 double, lower_whisker double, upper_whisker double, outliers bigint")
    q: dict[str, dict[float, float]] = {}
    for r in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).collect() if cols else []:
        q.setdefault(r["column"], {})[r["prob"]] = r["quantile"]
    if not q:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for i, (c, at) in enumerate(q.items()):
        v, spread = X.nan_to_null(_q(c).cast("double")), 1.5 * (at[0.75] - at[0.25])
        lo, hi = F.lit(at[0.25] - spread), F.lit(at[0.75] + spread)
        aggs.append(F.struct(F.lit(c).alias("column"), F.lit(at[0.25]).alias("q1"), F.lit(at[0.5]).alias("median"), F.lit(at[0.75]).alias("q3"),
                             F.min(F.when(v >= lo, v)).alias("lower_whisker"), F.max(F.when(v <= hi, v)).alias("upper_whisker"),
                             F.count_if((v < lo) | (v > hi)).alias("outliers")))
    return df.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))


def class_distribution(df: DataFrame, target: str = "Churn") -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("Customers"))


def churn_rate_by_category(df: DataFrame, by: list[str] = ("Contract", "TechSupport"),
                           target: str = "Churn") -> DataFrame:
    """Mean 0/1 target per value of each category column, via GROUPING SETS (one pass)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    y = X.map_target(_q(target), types[target])
    by = [c for c in by if c in df.columns]
    rows = df.select(*[_q(c) for c in by], y.alias("_y"))
    feature, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in by:
        feature = F.when(F.grouping(c) == 0, F.lit(c)).otherwise(feature)
        value = F.when(F.grouping(c) == 0, _q(c).cast("string")).otherwise(value)
    sets = rows.groupingSets([[_q(c)] for c in by], *[_q(c) for c in by])
    return sets.agg(feature.alias("Feature"), value.alias("Value"), F.avg("_y").alias("Churn_Rate"),
                    F.count(F.lit(1)).alias("Customers")).select("Feature", "Value", "Churn_Rate", "Customers")


def kde_by_class(df: DataFrame, column: str, target: str = "Churn", grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE per class (Scott bandwidth, each class normalised) on a shared grid.

    Distinct (class, value) pairs are counted first, then expanded over the
    ``grid`` points, so work is distinct values × grid.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    y = X.map_target(_q(target), types[target])
    v = X.to_number(_q(column), types[column])
    pts = df.select(y.alias("cls"), v.alias("v")).filter(F.col("v").isNotNull())
    counts = pts.groupBy("cls", "v").agg(F.count(F.lit(1)).alias("n"))
    par = pts.groupBy("cls").agg(F.count(F.lit(1)).alias("_cnt"), F.stddev_samp("v").alias("sd"),
                                 F.min("v").alias("lo"), F.max("v").alias("hi"))
    par = par.withColumn("h", F.col("sd") * F.pow(F.col("_cnt").cast("double"), F.lit(-0.2)))
    rng = par.agg(F.min(F.col("lo") - cut * F.col("h")).alias("g0"), F.max(F.col("hi") + cut * F.col("h")).alias("g1"))
    g0, g1 = rng.select("g0").scalar(), rng.select("g1").scalar()
    # per-class parameters (one row per class) are broadcast; each distinct
    # (class, value) row is expanded over the fixed ``grid`` points by a generator
    z = (counts.join(F.broadcast(par.select("cls", "_cnt", "h")), "cls")
         .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid - 1).cast("bigint"))).alias("k"))
         .withColumn("x", g0 + (g1 - g0) * F.col("k") / (grid - 1)))
    dens = z.groupBy("cls", "k").agg(
        F.first("x").alias("x"),
        (F.sum(F.col("n") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), 2)))
         / (F.first("_cnt") * F.first("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))
    return dens.select(F.col("cls").alias(target), F.lit(column).alias("column"), "k", "x", "density")
