"""The stored training table is dealt out over the cores, however its input is split."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from churnforge.operators import models as M
from churnforge.sources import fixtures


def test_one_split_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAST_ROWS", 100)
    raw = fixtures.subscribers(spark, SF_SMALL)
    cores = spark.sparkContext.defaultParallelism
    data = M.prepare_training(raw.coalesce(1))
    sizes = [r["count"] for r in data.train.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= cores
    assert max(sizes) * cores <= M.UNEVEN * data.n_train
    assert sum(sizes) == data.n_train
    ids = [r[0] for r in data.all_rows.select(M.KEY).collect()]
    assert sorted(ids) == sorted(r[0] for r in raw.select("customerID").collect())


def test_even_parts_stay_as_they_are(spark):
    raw = fixtures.subscribers(spark, SF_SMALL).repartition(16)
    data = M.prepare_training(raw)
    assert data.all_rows.rdd.getNumPartitions() == 16


def test_a_few_rows_stay_in_one_part(spark):
    data = M.prepare_training(fixtures.subscribers(spark, SF_SMALL).coalesce(1))
    assert data.all_rows.rdd.getNumPartitions() == 1


def test_keyless_and_repeated_rows_stay(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAST_ROWS", 50)
    raw = fixtures.subscribers(spark, SF_SMALL).limit(200).coalesce(1).withColumn(
        "customerID", F.when(F.col("tenure") > 30, F.col("customerID")))
    data = M.prepare_training(raw.unionAll(raw))
    assert data.all_rows.count() == 400
    assert data.n_train == data.train.count()
