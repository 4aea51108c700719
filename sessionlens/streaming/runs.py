"""Starting streaming queries."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter

_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_available(spark: SparkSession, writer: DataStreamWriter) -> None:
    """Run a query over all that is there and end. Without empty batches: an operator with timers asks for one after the other and would never end; its timers fire in batches with rows."""
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)
    query.awaitTermination()
