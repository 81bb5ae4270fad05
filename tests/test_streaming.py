"""The new-customer scorer runs unchanged as a Structured Streaming query."""

import os
import tempfile

from conftest import SF_SMALL
from churnforge.operators import models as M
from churnforge.plans.analytics import score_new_customers
from churnforge.sources import fixtures
from churnforge.streaming.scorer import score_stream


def test_stream_equals_batch(spark):
    subs = fixtures.subscribers(spark, SF_SMALL)
    data = M.prepare_training(subs)
    model, _ = M.fit_model(data, M.model_specs(data.n_train)[0])
    src = tempfile.mkdtemp(prefix="cf-stream-src-")
    new = subs.drop("Churn").limit(200)
    new.write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    q = score_stream(spark, os.path.join(src, "batch1"), new.schema, data, model,
                     checkpoint=tempfile.mkdtemp(prefix="cf-stream-ckpt-"), query_name="scored_stream_test")
    q.processAllAvailable()
    q.stop()
    streamed = {r.customerID: r.Probability for r in spark.sql("SELECT * FROM scored_stream_test").collect()}
    batch = {r.customerID: r.Probability for r in
             score_new_customers(spark.read.parquet(os.path.join(src, "batch1")), data, model).collect()}
    assert len(streamed) == 200 and streamed.keys() == batch.keys()
    assert all(abs(streamed[k] - batch[k]) < 1e-12 for k in batch)
