"""File sources and sinks: CSV (and mislabelled spreadsheets read as CSV),
missing-value tokens, type inference, report tables, dataset fingerprint.

Reads and writes are Spark jobs over directories; nothing passes through the
driver as bytes.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions import constants as K
from churnforge.functions import exprs as X
from churnforge.sources.csv_records import read_records

# --- fixed values: text read as missing by the usual CSV loaders (blank-only text is NOT one) ---
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
INT_PATTERN = r"^\s*[+-]?\d+\s*$"


def na_tokens(df: DataFrame, tokens: list[str] = NA_TOKENS) -> DataFrame:
    """Text equal to a missing-value token → null (one projection)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.when(F.col(f"`{c}`").isin(tokens), F.lit(None).cast("string"))
                       .otherwise(F.col(f"`{c}`")).alias(c) if X.is_string(types[c]) else F.col(f"`{c}`")
                       for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose every non-null value is an integer → int/bigint/decimal(38,0), a number → double.

    One aggregate decides all columns; a column with no values stays text.
    """
    texts = [f.name for f in df.schema.fields if X.is_string(f.dataType)]
    if not texts:
        return df
    aggs = []
    for i, c in enumerate(texts):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count_if(v.rlike(INT_PATTERN)).alias(f"i{i}"),
                 F.count_if(X.parse_number(v).isNotNull()).alias(f"d{i}"),
                 F.max(F.when(v.rlike(INT_PATTERN), F.abs(F.trim(v).try_cast("decimal(38,0)")))).alias(f"m{i}"),
                 F.count_if(v.rlike(INT_PATTERN) & F.trim(v).try_cast("decimal(38,0)").isNull()).alias(f"w{i}")]
    row = df.agg(*aggs).first()
    kinds = {}
    for i, c in enumerate(texts):
        n = row[f"n{i}"]
        if n and row[f"i{i}"] == n:
            # the narrowest type that holds every value; more than 38 digits stay text
            most = row[f"m{i}"]
            if not row[f"w{i}"]:
                kinds[c] = "int" if most < 2 ** 31 else "bigint" if most < 2 ** 63 else "decimal(38,0)"
        if c not in kinds and n and row[f"d{i}"] == n and not row[f"w{i}"]:
            kinds[c] = "double"
    cols = []
    for c in df.columns:
        if kinds.get(c) in ("int", "bigint", "decimal(38,0)"):
            cols.append(F.trim(F.col(f"`{c}`")).try_cast(kinds[c]).alias(c))
        elif kinds.get(c) == "double":
            cols.append(X.parse_number(F.col(f"`{c}`")).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return df.select(*cols)


def read_dataset(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Read by extension: .csv, or .xls/.xlsx which (lacking a spreadsheet engine)
    are read as CSV like the reference's mislabelled-file fallback; else ValueError.

    Quotes inside a quoted field are doubled. ``line_breaks`` allows them inside
    quoted fields; files are still read by many tasks (``csv_records``), in two passes.
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in K.SUPPORTED_EXTENSIONS:
        raise ValueError(f"cannot read {path!r}: expected one of {sorted(K.SUPPORTED_EXTENSIONS)}")
    if line_breaks:
        return infer_types(na_tokens(read_records(spark, path)))
    raw = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .option("nullValue", None).option("emptyValue", "").csv(path))
    return infer_types(na_tokens(raw))


def sink_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with header and doubled quotes, written by the executors as a directory of parts."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("nullValue", "").csv(path))


def report_tables(tables: dict[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """One directory per named table (metrics, models, predictions, clusters, risk, insights, clean)."""
    folders: dict[str, str] = {}
    for name in tables:
        folder = "".join(ch if ch.isalnum() else "_" for ch in name)
        if folder in folders:
            raise ValueError(f"tables {folders[folder]!r} and {name!r} would share the folder {folder!r}")
        folders[folder] = name
    out = {}
    for folder, name in folders.items():
        out[name] = os.path.join(base, folder)
        if fmt == "csv":
            sink_csv(tables[name], out[name])
        else:
            tables[name].write.mode("overwrite").parquet(out[name])
    return out


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content hash: (rows, Σ xxhash64(row) as a 38-digit decimal)."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("fingerprint"))
