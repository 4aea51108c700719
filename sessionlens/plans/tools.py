"""Tool decisions and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapter import Telemetry


def _accept():
    return F.col("decision") == "accept"


def _reject():
    return F.col("decision") == "reject"


def _auto():
    return _accept() & F.col("source").isin("config", "hook")


def scoped(t: Telemetry, since: int = 0, session: str = "") -> DataFrame:
    out = t.tool_decisions
    if since > 0:
        out = out.where(F.col("ts_ms") >= since)
    return out.where(F.col("session_id") == session) if session else out


def totals(t: Telemetry, since: int = 0, session: str = "") -> DataFrame:
    one = scoped(t, since, session).agg(F.count_if(_accept()).alias("accept"), F.count_if(_reject()).alias("reject"), F.count_if(_auto()).alias("auto"))
    decided = F.col("accept") + F.col("reject")
    return one.withColumn("reject_rate", F.round(F.when(decided > 0, F.col("reject") / decided).otherwise(0.0), 6))


def by_source(t: Telemetry, since: int = 0, session: str = "") -> DataFrame:
    return scoped(t, since, session).groupBy("source").agg(F.count_if(_accept()).alias("accept"), F.count_if(_reject()).alias("reject")).orderBy("source")


def hotspots(t: Telemetry, top: int = 5, since: int = 0, session: str = "") -> DataFrame:
    """Tools with most rejections, and each one's share of the largest."""
    rows = scoped(t, since, session).groupBy("tool_name").agg(F.count_if(_reject()).alias("reject"), F.count(F.lit(1)).alias("total")).where("reject > 0")
    rows = rows.orderBy(F.desc("reject"), "tool_name").limit(top)
    return rows.withColumn("width", F.round(F.col("reject") / F.max("reject").over(Window.partitionBy()), 6))


def last_results(t: Telemetry, n: int = 10) -> DataFrame:
    """Each session's newest n results, to be shown in ascending order; n <= 0 keeps all."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("ts_ms"), F.desc("id"))
    rows = t.tool_results.withColumn("newest", F.row_number().over(newest).cast("bigint"))
    return (rows.where(F.col("newest") <= n) if n > 0 else rows).select("session_id", "id", "ts_ms", "tool_name", "success", "duration_ms", "newest")
