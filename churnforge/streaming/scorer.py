"""Structured Streaming form of new-customer scoring.

New customer rows arriving as files are scored with the fitted encoding,
scaling row and model — the same row-wise chain as the batch job — and
appended to a sink. The query is stateless (no aggregation, no join), so
``append`` mode needs no watermark; progress is kept in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from churnforge.operators import models as M
from churnforge.plans.analytics import score_new_customers


def score_stream(spark: SparkSession, source_dir: str, schema: StructType, data: M.TrainingData, model,
                 checkpoint: str, sink: str | None = None, query_name: str | None = None,
                 currency: str = "USD", fmt: str = "parquet", max_files: int = 100) -> StreamingQuery:
    """Start the scoring stream; ``sink`` is a directory (files) or None with ``query_name`` (memory)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .format(fmt).load(source_dir))
    scored = score_new_customers(stream, data, model, currency)
    writer = scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if sink is None:
        return writer.format("memory").queryName(query_name or "scored_customers").start()
    return writer.format("parquet").option("path", sink).start()
