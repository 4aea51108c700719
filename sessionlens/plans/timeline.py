"""Merged session timelines, prompts, and the 60-second burn rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapter import Telemetry

#: Attributes that hold an error's text, and those that a log line shows.
ERROR_KEYS = ("error", "error_message", "message")
TAIL_KEYS = ("prompt_length", "model", "cost_usd", "tool_name", "decision", "source", "success", "server_name", "duration_ms")


def prompt_fields(events: DataFrame) -> DataFrame:
    """events with prompt_length, if a JSON number, and prompt, if a non-empty JSON string."""
    value = F.try_parse_json("attrs_json")
    found = F.try_variant_get(value, "$.prompt_length", "variant")
    is_number = F.schema_of_variant(found).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    length = F.when(is_number, F.try_variant_get(value, "$.prompt_length", "double").try_cast("bigint"))
    return events.withColumn("prompt_length", length).withColumn("prompt", F.nullif(F.try_variant_get(value, "$.prompt", "string"), F.lit("")))


def error_texts(rows: DataFrame) -> DataFrame:
    """rows with `error`: the first of these that attrs_json has as a text that isn't empty."""
    value = F.try_parse_json("attrs_json")

    def text(name: str) -> Column:
        found = F.try_variant_get(value, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.try_variant_get(value, f"$.{name}", "string"), F.lit("")))

    return rows.withColumn("error", F.coalesce(*map(text, ERROR_KEYS)))


def tail_fields(attrs_json: Column) -> Column:
    """What a log line shows of an event's attributes, as JSON; `{}` if there are none or they aren't JSON."""
    value = F.try_parse_json(attrs_json)
    field = lambda name: F.concat(F.lit(f'"{name}":'), F.to_json(F.try_variant_get(value, f"$.{name}", "variant")))
    return F.concat(F.lit("{"), F.concat_ws(",", *map(field, TAIL_KEYS)), F.lit("}"))


def timeline(t: Telemetry) -> DataFrame:
    """Prompts, requests, decisions and results of every session on one axis; order by ts_ms, seq, id."""
    prompts = prompt_fields(t.events.where("name = 'user_prompt'")).select("session_id", "ts_ms", "id", F.lit(0).alias("seq"), F.lit("prompt").alias("kind"), F.coalesce("prompt", F.lit("")).alias("label"), F.coalesce("prompt_length", F.lit(0)).alias("amount"))
    requests = t.api_requests.select("session_id", "ts_ms", "id", F.lit(1).alias("seq"), F.when(F.col("is_error"), "api_error").otherwise("api").alias("kind"), F.col("model").alias("label"), (F.col("input_tokens") + F.col("output_tokens")).alias("amount"))
    decisions = t.tool_decisions.select("session_id", "ts_ms", "id", F.lit(2).alias("seq"), F.lit("decision").alias("kind"), F.concat_ws(":", "tool_name", "decision").alias("label"), F.lit(0).cast("bigint").alias("amount"))
    results = t.tool_results.select("session_id", "ts_ms", "id", F.lit(3).alias("seq"), F.lit("result").alias("kind"), F.col("tool_name").alias("label"), F.col("duration_ms").alias("amount"))
    return prompts.unionByName(requests).unionByName(decisions).unionByName(results)


def log_rows(t: Telemetry) -> DataFrame:
    """The four kinds of rows that a log shows, with the fields of each; order by ts_ms, seq, id."""
    prompts = prompt_fields(t.events)
    parts = [
        prompts.select("session_id", "ts_ms", "id", F.lit(0).alias("seq"), F.col("name").alias("kind"), "prompt_length"),
        t.api_requests.select("session_id", "ts_ms", "id", F.lit(1).alias("seq"), F.when(F.col("is_error"), "api_error").otherwise("api_request").alias("kind"), "model", "input_tokens", "output_tokens", "cost_usd", "duration_ms", "status_code"),
        t.tool_decisions.select("session_id", "ts_ms", "id", F.lit(2).alias("seq"), F.lit("tool_decision").alias("kind"), "tool_name", "decision", "source"),
        t.tool_results.select("session_id", "ts_ms", "id", F.lit(3).alias("seq"), F.lit("tool_result").alias("kind"), "tool_name", "success", *(c for c in ("bash_command", "mcp_server") if c in t.tool_results.columns)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select("*", *(F.lit("").alias(c) for c in ("bash_command", "mcp_server") if c not in out.columns))


def with_indent(rows: DataFrame) -> DataFrame:
    """Level of each timeline row. Between prompts, a request's level is the number of tool runs before it, a tool's one more than at the latest request; 2 at most."""
    order = Window.partitionBy("session_id").orderBy("ts_ms", "seq", "id")
    is_api, is_tool = F.col("seq") == 1, F.col("seq") >= 2
    rows = rows.withColumn("_segment", F.sum((F.col("seq") == 0).cast("int")).over(order))
    inside = Window.partitionBy("session_id", "_segment").orderBy("ts_ms", "seq", "id")
    after_tool = F.coalesce(is_api & (F.lag("seq").over(inside) >= 2), F.lit(False))
    rows = rows.withColumn("_runs", F.sum(after_tool.cast("int")).over(inside))
    level = F.when(F.col("seq") == 0, 0).when(is_tool, F.least(F.lit(2), F.col("_runs") + 1)).otherwise(F.least(F.lit(2), F.col("_runs")))
    return rows.withColumn("level", level.cast("bigint")).drop("_segment", "_runs")


def newest_prompts(t: Telemetry, n: int = 3) -> DataFrame:
    newest = Window.partitionBy("session_id").orderBy(F.desc("ts_ms"), F.desc("id"))
    rows = prompt_fields(t.events.where("name = 'user_prompt'")).withColumn("newest", F.row_number().over(newest).cast("bigint"))
    return rows.where(F.col("newest") <= n).select("session_id", "id", "ts_ms", "prompt_length", F.coalesce("prompt", F.lit("")).alias("prompt"), F.col("prompt").isNotNull().alias("stored"), "newest")


def burn_rate(requests: DataFrame, window_ms: int = 60_000, stale_ms: int = 15_000) -> DataFrame:
    """USD and tokens a minute over the last minute of each session's own running totals; 0 with one sample, or after a gap over stale_ms."""
    order = Window.partitionBy("session_id").orderBy("ts_ms", "id")
    rows = requests.withColumn("_cost", F.sum("cost_usd").over(order)).withColumn("_tokens", F.sum(F.col("input_tokens") + F.col("output_tokens")).over(order))
    span = Window.partitionBy("session_id").orderBy("ts_ms").rangeBetween(-window_ms, 0)
    oldest = F.min(F.struct("ts_ms", "id", "_cost", "_tokens")).over(span)
    rows = rows.withColumn("_old", oldest).withColumn("_gap", F.col("ts_ms") - F.lag("ts_ms").over(order))
    minutes = (F.col("ts_ms") - F.col("_old.ts_ms")) / 60000
    live = (minutes > 0) & (F.coalesce("_gap", F.lit(0)) <= stale_ms)
    rate = lambda c: F.round(F.when(live, F.greatest(F.lit(0.0), (F.col(c) - F.col(f"_old.{c}")) / minutes)).otherwise(0.0), 6)
    return rows.select("session_id", "id", "ts_ms", rate("_cost").alias("usd_per_min"), rate("_tokens").alias("tok_per_min"))
