"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Only a local session, as in tests, may do without and gets a folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sessionlens-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def by_kind(rows: DataFrame, what: str, counters: dict[str, Column]) -> tuple[DataFrame, dict[tuple[str, str], int]]:
    """rows, written once in folders by their column `kind` (a reader of one kind reads that folder alone), and what the counters count on the way."""
    path = new_folder(rows.sparkSession, what)
    seen = Observation(what)
    rows.observe(seen, *(c.cast("long").alias(n) for n, c in counters.items())).write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), {(what, n): v or 0 for n, v in seen.get.items()}
