"""Session list, detail, latest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import axis
from ..sources.adapter import Telemetry

SORTS = {"last_seen": "last_seen", "cost": "cost_usd", "tokens": "tokens"}


def page_limit(limit: int) -> int:
    return limit if 0 < limit <= 1000 else 50


def session_list(t: Telemetry, since: int = 0, prefix: str = "") -> DataFrame:
    """Every session with its resolved totals and tool counts. `prefix` is matched without case; % and _ in it are wildcards."""
    sessions = t.sessions.drop("token_source")  # resolved anew from what is stored
    if since > 0:
        sessions = sessions.where(F.col("last_seen") >= since)
    if prefix.strip():
        sessions = sessions.where(F.lower("id").like(prefix.strip().lower() + "%"))
    totals = axis.session_totals(t.api_requests, t.metric_points)
    tools = t.tool_decisions.groupBy("session_id").agg(F.count_if(F.col("decision") == "accept").alias("tool_accept"), F.count_if(F.col("decision") == "reject").alias("tool_reject"))
    joined = sessions.join(totals, sessions["id"] == totals["session_id"], "left").drop("session_id")
    joined = joined.join(tools, joined["id"] == tools["session_id"], "left").drop("session_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = joined.select("id", "first_seen", "last_seen", "model_set", F.coalesce("token_source", F.lit("")).alias("token_source"), F.round(F.coalesce("cost_usd", F.lit(0.0)), 6).alias("cost_usd"), *map(zero, (*axis.KINDS, "tool_accept", "tool_reject")))
    decided = F.col("tool_accept") + F.col("tool_reject")
    return out.withColumn("duration_sec", F.round(F.greatest(F.lit(0.0), (F.col("last_seen") - F.col("first_seen")) / 1000), 6)).withColumn("tool_accept_rate", F.round(F.when(decided > 0, F.col("tool_accept") / decided).otherwise(0.0), 6))


def session_page(t: Telemetry, sort: str = "last_seen", ascending: bool = False, limit: int = 50, offset: int = 0, since: int = 0, prefix: str = "") -> DataFrame:
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {sorted(SORTS)}")
    rows = session_list(t, since, prefix).withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
    column = F.col(SORTS[sort])
    return rows.orderBy(column.asc() if ascending else column.desc(), "id").offset(max(0, offset)).limit(page_limit(limit)).drop("tokens")


def model_breakdown(t: Telemetry) -> DataFrame:
    """Cost and tokens by session and model; sessions without requests show their metric cost by model, without tokens."""
    events = t.api_requests.groupBy("session_id", "model").agg(F.sum("cost_usd").alias("cost_usd"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    points = axis.metric_only(t.metric_points.where(F.col("name").isin(*axis.COST)), t.api_requests)
    metrics = points.groupBy("session_id", F.col("attr_key").alias("model")).agg(F.sum("value_delta").alias("cost_usd"), F.lit(0).cast("bigint").alias("tokens"))
    return events.unionByName(metrics).withColumn("cost_usd", F.round("cost_usd", 6))


def latest_session(t: Telemetry) -> DataFrame:
    return t.sessions.orderBy(F.desc("last_seen"), "id").limit(1)


def latest_tools(t: Telemetry) -> DataFrame:
    """The last tool of each session: the decision of largest (ts, id)."""
    return t.tool_decisions.groupBy("session_id").agg(F.max(F.struct("ts_ms", "id", "tool_name")).alias("m")).select("session_id", F.col("m.ts_ms").alias("ts_ms"), F.col("m.tool_name").alias("tool_name"))


def active_time(t: Telemetry) -> DataFrame:
    return t.metric_points.where(F.col("name").isin(*axis.ACTIVE)).groupBy("session_id").agg(F.round(F.sum("value_delta"), 6).alias("active_sec"))


def snapshots(t: Telemetry) -> DataFrame:
    """session_list() with automatic approvals, the share of input that came from the cache, and the last tool."""
    auto = t.tool_decisions.where(F.col("decision") == "accept").where(F.col("source").isin("config", "hook")).groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("auto_approved"))
    tool = latest_tools(t).select(F.col("session_id").alias("id"), F.col("tool_name").alias("last_tool"))
    rows = session_list(t).join(auto, "id", "left").join(tool, "id", "left")
    whole = F.col("input_tokens") + F.col("cache_read")
    ratio = F.when(whole > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cache_read") / whole))).otherwise(0.0)
    return rows.withColumn("auto_approved", F.coalesce("auto_approved", F.lit(0))).withColumn("last_tool", F.coalesce("last_tool", F.lit(""))).withColumn("cache_hit_ratio", F.round(ratio, 6))


class NotFound(LookupError):
    """A session that isn't there; str() is the body that a front end answers with."""

    def __init__(self, what: str = "session"):
        super().__init__(json.dumps({"error": {"code": "not_found", "message": f"{what} not found"}}))


def known_sessions(t: Telemetry, asked: DataFrame) -> DataFrame:
    """id and found of each asked id."""
    there = t.sessions.select("id").distinct().withColumn("found", F.lit(True))
    return asked.select("id").join(there, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def require(t: Telemetry, session_id: str) -> None:
    """Raise NotFound unless the session is there; reads until its first row."""
    if t.sessions.where(F.col("id") == session_id).limit(1).isEmpty():
        raise NotFound
