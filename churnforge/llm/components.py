"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from churnforge.llm.common import stored
from churnforge.session import release_scratch


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link to another; root is the smallest node that can be reached.

    ``links`` has two columns of one type. Each round points the neighbours of
    a node to the least of them (only minima are gathered, so a node with very
    many links costs no task more than its share) and is written to the shared
    folder; rounds end when only stars are left, after about the logarithm of the longest path.
    """
    a, b = links.columns
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    written = None
    while True:
        old, e = written, stored(e, "links")
        written = e.inputFiles()
        if old:
            release_scratch(e.sparkSession, old[0].rpartition("/")[0])
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # done when every node has one link up, or only links down
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # a > b in e, so b's larger neighbours are the rows of e with that b
        large = e.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
