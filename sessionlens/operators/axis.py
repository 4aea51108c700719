"""Axis of truth: a session's cost and tokens come from its API requests if it has any, else from its metric points; never from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and token kinds that metrics come under.
COST = ("cost.usage", "claude_code.cost.usage")
TOKENS = ("token.usage", "claude_code.token.usage")
ACTIVE = ("active_time.total", "claude_code.active_time.total")
KINDS = {
    "input_tokens": ("input", "input_tokens"),
    "output_tokens": ("output", "output_tokens"),
    "cache_read": ("cacheRead", "cache_read", "cache_read_tokens"),
    "cache_creation": ("cacheCreation", "cache_creation", "cache_creation_tokens"),
}


def _metric_cost() -> Column:
    return F.sum(F.when(F.col("name").isin(*COST), F.col("value_delta")).otherwise(0.0))


def _metric_tokens(kind: str, any_name: bool) -> Column:
    """Cut to a whole number once, after the sum."""
    of_kind = F.col("attr_key").isin(*KINDS[kind])
    return F.sum(F.when(of_kind if any_name else of_kind & F.col("name").isin(*TOKENS), F.col("value_delta")).otherwise(0.0)).cast("bigint")


def session_totals(api_requests: DataFrame, metric_points: DataFrame) -> DataFrame:
    """session_id, token_source, cost_usd and four token sums of every session with either source; each source is added up once, by session."""
    events = api_requests.groupBy("session_id").agg(F.sum("cost_usd").alias("e_cost_usd"), *(F.sum(k).alias(f"e_{k}") for k in KINDS), F.lit(True).alias("has_api"))
    used = metric_points.where(F.col("name").isin(*COST, *TOKENS))
    metrics = used.groupBy("session_id").agg(_metric_cost().alias("m_cost_usd"), *(_metric_tokens(k, False).alias(f"m_{k}") for k in KINDS), F.lit(True).alias("has_metric"))
    both = events.join(metrics, "session_id", "full_outer")
    source = F.when(F.col("has_api"), "events").when(F.col("has_metric"), "metrics").otherwise("")
    zero = {"cost_usd": F.lit(0.0)} | {k: F.lit(0).cast("bigint") for k in KINDS}
    resolved = [F.coalesce(F.when(F.col("has_api"), F.coalesce(f"e_{k}", z)).otherwise(F.col(f"m_{k}")), z).alias(k) for k, z in zero.items()]
    return both.select("session_id", source.alias("token_source"), *resolved)


def metric_only(metric_points: DataFrame, api_requests: DataFrame) -> DataFrame:
    """Points of sessions without any API request."""
    return metric_points.join(api_requests.select("session_id").distinct(), "session_id", "left_anti")


def scope_requests(api_requests: DataFrame, since: int = 0, model: str = "", session: str = "") -> DataFrame:
    out = api_requests
    if since > 0:
        out = out.where(F.col("ts_ms") >= since)
    if model:
        out = out.where(F.col("model") == model)
    if session:
        out = out.where(F.col("session_id") == session)
    return out


def scope_metrics(metric_points: DataFrame, api_requests: DataFrame, since: int = 0, model: str = "", session: str = "") -> DataFrame:
    """Cost and token points of metric-only sessions; a model narrows cost points only, as token points don't carry it."""
    out = metric_points.where(F.col("name").isin(*COST, *TOKENS))
    if since > 0:
        out = out.where(F.col("ts_ms") >= since)
    if session:
        out = out.where(F.col("session_id") == session)
    if model:
        out = out.where(F.col("name").isin(*TOKENS) | (F.col("attr_key") == model))
    return metric_only(out, api_requests)


def bucketed(requests: DataFrame, points: DataFrame, width_ms: int) -> DataFrame:
    """ts, cost_usd and four token sums by bucket and by source; metric tokens are cut to whole numbers by bucket."""
    bucket = F.expr(f"(ts_ms div {width_ms}) * {width_ms}").alias("ts")
    events = requests.groupBy(bucket).agg(F.sum("cost_usd").alias("cost_usd"), *(F.sum(k).alias(k) for k in KINDS))
    metrics = points.groupBy(bucket).agg(_metric_cost().alias("cost_usd"), *(_metric_tokens(k, True).alias(k) for k in KINDS))
    return events.withColumn("from_metrics", F.lit(False)).unionByName(metrics.withColumn("from_metrics", F.lit(True)))
