"""Registered queries: key → callable(spark, sf_dir) -> DataFrame.

Every query reads the scale-factor tables (through the fixtures derived from
``orders ⨝ customer`` or the tables themselves), so its work grows with them.
Double outputs are rounded to 6 places for engine-independent comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from churnforge.plans.frames import rounded

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def query(key: str):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _REGISTRY[key] = run
        return run
    return deco


def all_queries() -> dict[str, QueryFn]:
    # importing the modules registers their queries
    from churnforge.plans import (q_business, q_clean, q_features, q_models, q_pipeline,  # noqa: F401
                                  q_profile, q_segment)
    return dict(_REGISTRY)
