"""Cost series, breakdowns and rollups over the axis of truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import cache_saved
from ..operators import axis
from ..sources.adapter import Telemetry

WIDTHS = {"hour": 3_600_000, "day": 86_400_000}
SUMS = ("cost_usd", *axis.KINDS)


def width_of(bucket: str) -> int:
    if bucket not in WIDTHS:
        raise ValueError(f"bucket must be one of {sorted(WIDTHS)}")
    return WIDTHS[bucket]


def _buckets(t: Telemetry, width: int, since: int, model: str, session: str) -> DataFrame:
    requests = axis.scope_requests(t.api_requests, since, model, session)
    points = axis.scope_metrics(t.metric_points, t.api_requests, since, model, session)
    return axis.bucketed(requests, points, width)


def cost_series(t: Telemetry, bucket: str = "hour", since: int = 0, model: str = "", session: str = "") -> DataFrame:
    """Sums by bucket and the running cost. The window runs over one row a bucket, whose number follows the time span, not the facts."""
    series = _buckets(t, width_of(bucket), since, model, session).groupBy("ts").agg(*(F.sum(c).alias(c) for c in SUMS))
    running = F.sum("cost_usd").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("cumulative_usd", F.round(running, 6)).withColumn("cost_usd", F.round("cost_usd", 6))


def _models(t: Telemetry, since: int = 0, model: str = "", session: str = "") -> DataFrame:
    requests = axis.scope_requests(t.api_requests, since, model, session).select("model", "cost_usd", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    points = axis.scope_metrics(t.metric_points, t.api_requests, since, model, session).where(F.col("name").isin(*axis.COST))
    rows = requests.unionByName(points.select(F.col("attr_key").alias("model"), F.col("value_delta").alias("cost_usd"), F.lit(0).cast("bigint").alias("tokens")))
    return rows.groupBy("model").agg(F.sum("cost_usd").alias("cost_usd"), F.sum("tokens").alias("tokens"))


def cost_by_model(t: Telemetry, since: int = 0, model: str = "", session: str = "") -> DataFrame:
    rows = _models(t, since, model, session)
    total = F.sum("cost_usd").over(Window.partitionBy())  # over one row a model
    pct = F.when(total > 0, F.col("cost_usd") / total).otherwise(0.0)
    return rows.select("model", F.round("cost_usd", 6).alias("cost_usd"), "tokens", F.round(pct, 6).alias("pct")).orderBy(F.desc("cost_usd"), "model")


def cost_rollup(t: Telemetry, bucket: str = "hour", since: int = 0, model: str = "", session: str = "") -> DataFrame:
    """One row: total, burn rates, cache hit ratio, what the cache saved, source label."""
    width = width_of(bucket)
    parts = _buckets(t, width, since, model, session)
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read") + F.col("cache_creation")
    one = parts.agg(
        F.sum("cost_usd").alias("total"), F.sum(tokens).alias("tokens"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("input_tokens").alias("input"), F.sum("cache_read").alias("cached"),
        F.coalesce(F.bool_or(F.col("from_metrics")), F.lit(False)).alias("metrics"), F.coalesce(F.bool_or(~F.col("from_metrics")), F.lit(False)).alias("events"),
    )
    priced = axis.scope_requests(t.api_requests, since, model, session).groupBy("model").agg(F.sum("cache_read").alias("cr")).agg(F.sum(cache_saved(F.col("model"), F.col("cr"))).alias("saved"))
    minutes = (F.col("last") + width - F.col("first")) / 60000
    ratio = F.when(F.col("input") + F.col("cached") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cached") / (F.col("input") + F.col("cached"))))).otherwise(0.0)
    label = F.when(F.col("events") & F.col("metrics"), "mixed").when(F.col("events"), "events").when(F.col("metrics"), "metrics").otherwise("")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return one.crossJoin(priced).select(  # one row each
        zero(F.col("total")).alias("total_cost_usd"), zero(F.col("total") / minutes).alias("burn_usd_per_min"), zero(F.col("tokens") / minutes).alias("burn_tok_per_min"), zero(ratio).alias("cache_hit_ratio"),
        F.round("saved", 6).alias("cache_saved_usd"), (F.coalesce("cached", F.lit(0)) > 0).alias("cache_saved_estimated"), label.alias("token_source"),
    )
