"""Feature engineering: service flag, binary maps, one-hot with a fitted
vocabulary, currency, coercion, hash split, scaling and class weights.

Fitted state (vocabulary, scaling row, weights) is parameter-sized and is
collected once; applying it is a single projection (``transform``), so the
same fitted objects score any table, of any size, later.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnforge.functions import constants as K
from churnforge.functions import exprs as X
from churnforge.operators.clean import require_columns
from churnforge.operators.stats import hash_unit, running_sum, value_counts_long

MAX_CATEGORIES = 1000


def _q(c: str) -> F.Column:
    return F.col(f"`{c}`")


def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


# ---------------------------------------------------------------------------------------
# vocabulary
# ---------------------------------------------------------------------------------------
def fit_vocabulary(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null text values per column, from one pass.

    The values become columns, so they must be few: at most ``MAX_CATEGORIES + 1``
    of a column reach the driver. ``category_table`` and ``one_hot_sparse`` have no such bound.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    values = value_counts_long(df, cols, keep_null=False).select("column", "value")
    few = values.withColumn("_n", F.row_number().over(Window.partitionBy("column").orderBy("value"))).filter(F.col("_n") <= MAX_CATEGORIES + 1)
    vocab: dict[str, list[str]] = {c: [] for c in cols}
    for r in few.collect():
        vocab[r["column"]].append(r["value"])
    for c, vals in vocab.items():
        if len(vals) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} categories; use one_hot_sparse")
        vals.sort()
    return vocab


def category_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, index): the vocabulary as a table, numbered from 0 in order of (column, value); any size."""
    values = value_counts_long(df, [c for c in cols if c in df.columns], keep_null=False)
    named = values.select(F.concat_ws("\u0000", "column", "value").alias("_k"), "column", "value", F.lit(1).alias("one"))
    return running_sum(named, "_k", ["one"]).select("column", "value", (F.col("cum_one") - 1).alias("index"))


def one_hot_sparse(df: DataFrame, vocabulary: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, indices): the sorted numbers of a row's categories, by an equi-join with the vocabulary table.

    The sparse form of a one-hot row for any number of categories; null and unseen values have no number.
    One row for each row of ``df``, also where keys are missing or repeated.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in cols])
    numbered = df.select(_q(key).alias("_key"), pairs.alias("_pairs"), F.monotonically_increasing_id().alias("_row"))
    joined = numbered.select("_row", "_key", F.explode("_pairs").alias("kv")).select("_row", "_key", "kv.*").join(vocabulary, ["column", "value"], "left")
    return joined.groupBy("_row", "_key").agg(F.array_sort(F.collect_list("index")).alias("indices")).select(F.col("_key").alias(key), "indices")


def one_hot(df: DataFrame, vocab: dict[str, list[str]], drop_first: bool) -> DataFrame:
    """Replace each vocabulary column by 0/1 columns ``{col}_{value}`` (appended at the end).

    Sorted categories; ``drop_first`` drops the smallest. Null or unseen → all 0.
    """
    cols = [c for c in vocab if c in df.columns]
    keep = [_q(c) for c in df.columns if c not in cols]
    dummies = []
    for c in cols:
        values = vocab[c][1:] if drop_first else vocab[c]
        dummies += [F.when(_q(c).cast("string") == v, 1).otherwise(0).alias(f"{c}_{v}") for v in values]
    return df.select(*keep, *dummies)


# ---------------------------------------------------------------------------------------
# row rules
# ---------------------------------------------------------------------------------------
def has_service(df: DataFrame, drop: bool = True) -> DataFrame:
    """1 when any of the five service columns is "Yes" (TechSupport is not one of them)."""
    present = [c for c in K.SERVICE_COLUMNS if c in df.columns]
    flag = F.greatest(*[F.when(_q(c) == "Yes", 1).otherwise(0) for c in present]) if len(present) > 1 else (
        F.when(_q(present[0]) == "Yes", 1).otherwise(0) if present else F.lit(0))
    out = df.withColumn("HasService", flag.cast("int"))
    return out.drop(*present) if drop else out


def map_target(df: DataFrame, target: str = "Churn") -> DataFrame:
    return df.withColumn(target, X.map_target(_q(target), _types(df)[target]))


def map_binary(df: DataFrame, maps: dict = K.BINARY_MAPS) -> DataFrame:
    """Yes/No-style text → 0/1 (unknown → 0). Already numeric columns pass through (T7)."""
    types = _types(df)
    out = df
    for c, m in maps.items():
        if c in df.columns:
            if X.is_numeric(types[c]):
                out = out.withColumn(c, F.coalesce(_q(c).cast("int"), F.lit(0)))
            else:
                out = out.withColumn(c, X.map_values(_q(c), m, 0).cast("int"))
    return out


def map_binary_segment(df: DataFrame) -> DataFrame:
    types = _types(df)
    out = df
    for c in K.SEGMENT_BINARY_COLUMNS:
        if c in df.columns:
            if X.is_numeric(types[c]):
                out = out.withColumn(c, F.coalesce(_q(c).cast("double"), F.lit(0.0)))
            else:
                out = out.withColumn(c, X.map_values(_q(c), K.SEGMENT_BINARY_MAP, 0).cast("double"))
    return out


def to_sar(df: DataFrame, rate: float = K.USD_TO_SAR) -> DataFrame:
    """Money → number (bad/missing → 0) × rate."""
    types = _types(df)
    out = df
    for c in K.MONEY_COLUMNS:
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(X.to_number(_q(c), types[c]), F.lit(0.0)) * F.lit(rate))
    return out


def coerce_all_numeric(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """Every column except ``keep`` → double; unparseable/missing → 0."""
    types = _types(df)
    return df.select(*[_q(c) if c in keep else
                       F.coalesce(X.to_number(_q(c), types[c]), F.lit(0.0)).alias(c) for c in df.columns])


# ---------------------------------------------------------------------------------------
# composites
# ---------------------------------------------------------------------------------------
@dataclass
class ChurnEncoding:
    vocabulary: dict[str, list[str]]
    feature_columns: list[str] = field(default_factory=list)


def churn_features(df: DataFrame, encoding: ChurnEncoding | None = None, key: str = "customerID",
                   target: str = "Churn", passthrough: tuple = (), extra: tuple = ()) -> tuple[DataFrame, ChurnEncoding]:
    """(key, features..., target) as doubles/ints; the vocabulary is fitted unless given.

    Columns outside the known list are left out, but for those named in ``extra``.

    ``passthrough`` columns are carried unchanged (no join needed to re-attach them).
    """
    require_columns(df, [target, "MonthlyCharges", "TotalCharges", "tenure"])
    df = _known(df, K.TELCO_COLUMNS, (key, target, *passthrough, *extra))
    types = _types(df)
    out = df.withColumn("TotalCharges", F.coalesce(X.to_number(_q("TotalCharges"), types["TotalCharges"]),
                                                   F.lit(0.0)))
    out = has_service(out)
    out = out.drop(*[c for c in K.CHURN_DROP_COLUMNS if c != key and c in out.columns])
    out = map_target(out, target)
    out = map_binary(out)
    out = to_sar(out)
    if encoding is None:
        encoding = ChurnEncoding(fit_vocabulary(out, K.CHURN_DUMMY_COLUMNS))
    out = one_hot(out, encoding.vocabulary, drop_first=True)
    keep = tuple(c for c in (key, target, *passthrough) if c in out.columns)
    out = coerce_all_numeric(out, keep)
    feats = [c for c in out.columns if c not in keep]
    if encoding.feature_columns:
        out = align_features(out, encoding.feature_columns, keep)
    else:
        encoding.feature_columns = feats
    return out, encoding


def _known(df: DataFrame, known: tuple, more: tuple) -> DataFrame:
    return df.select(*[_q(c) for c in df.columns if c in known or c in more])


def align_features(df: DataFrame, feature_columns: list[str], keep: tuple = ()) -> DataFrame:
    """Reorder to the fitted feature list; absent features become 0."""
    return df.select(*[_q(c) for c in keep],
                     *[(_q(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in feature_columns])


def segment_features(df: DataFrame, vocab: dict | None = None, key: str = "customerID", extra: tuple = ()
                     ) -> tuple[DataFrame, dict, list[str]]:
    """(key, features...) for clustering: SAR money, binary maps, full one-hot, all numeric; known columns and ``extra`` only."""
    require_columns(df, ["MonthlyCharges", "TotalCharges", "tenure"])
    out = to_sar(_known(df, K.TELCO_COLUMNS, (key, *extra)))
    out = out.drop(*[c for c in K.SEGMENT_DROP_COLUMNS if c != key and c in out.columns])
    out = map_binary_segment(out)
    if vocab is None:
        vocab = fit_vocabulary(out, K.SEGMENT_DUMMY_COLUMNS)
    out = one_hot(out, vocab, drop_first=False)
    keep = (key,) if key in out.columns else ()
    out = coerce_all_numeric(out, keep)
    return out, vocab, [c for c in out.columns if c not in keep]


def split_80_20(df: DataFrame, key: str = "customerID", test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: a stable hash split on the key (not on partitioning or row order); rows without a key split on the whole row."""
    row = F.concat_ws("\u0000", F.lit("row"), *[F.coalesce(_q(c).cast("string"), F.lit("")) for c in df.columns])
    return df.withColumn("is_test", (hash_unit(F.coalesce(_q(key).cast("string"), row), seed) < test_pct).cast("int"))


@dataclass
class Scaling:
    mean: dict[str, float]
    std: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        cols = []
        for c in df.columns:
            if c in self.mean:
                s = self.std[c] if self.std[c] else 1.0
                cols.append(((_q(c).cast("double") - F.lit(self.mean[c])) / F.lit(s)).alias(c))
            else:
                cols.append(_q(c))
        return df.select(*cols)


def fit_scaling(df: DataFrame, cols: list[str]) -> Scaling:
    """Mean and population std per column (one aggregate); zero std leaves x − mean."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(_q(c).cast("double")).alias(f"m{i}"), F.stddev_pop(_q(c).cast("double")).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return Scaling({c: row[f"m{i}"] for i, c in enumerate(cols)}, {c: row[f"s{i}"] for i, c in enumerate(cols)})


def class_counts(df: DataFrame, label: str = "Churn") -> dict[int, int]:
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def balanced_weights(df: DataFrame, label: str = "Churn", out: str = "weight") -> DataFrame:
    """w = n / (2 · n_class) attached from the ≤2-row class table (broadcast)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = counts.agg(F.sum("_nc")).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    w = counts.select(label, (n / (k * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label, "left")


def scale_pos_weight(df: DataFrame, label: str = "Churn") -> DataFrame:
    return df.agg(F.greatest(F.lit(1.0), F.count_if(F.col(label) == 0)
                             / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("scale_pos_weight"))


def encoded_feature_count(df: DataFrame, exempt=("customerID", "Churn")) -> DataFrame:
    from churnforge.operators.clean import encoded_feature_count as count
    return df.sparkSession.createDataFrame([(count(df, exempt),)], "Encoded_ML_Features int")
