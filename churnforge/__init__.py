"""churnforge: customer-retention analytics as Spark DataFrame operators.

Every operator is ``f(df, **params) -> DataFrame`` (usable with ``df.transform``)
and is planned by Catalyst; only parameter-sized results (medians, class counts,
centroids, coefficients) are ever brought to the driver.
"""

from churnforge.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
