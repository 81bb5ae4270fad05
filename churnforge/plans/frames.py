"""Named input frames the registered queries start from (all derived from the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from churnforge.operators import business as B
from churnforge.operators import profiles as P
from churnforge.sources import fixtures


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (engine-independent comparison of results)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed-score analysis frame: normalised money, 0/1 target, names, tier, priority, offer."""
    an = B.analysis_frame(fixtures.scored(spark, sf_dir))
    names = P.cluster_names(P.cluster_profile(an))
    return B.scored_table(an, names)


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    an = B.analysis_frame(fixtures.scored(spark, sf_dir))
    return P.cluster_names(P.cluster_profile(an))
