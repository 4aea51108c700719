"""Session export documents."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapter import Telemetry
from .sessions import require

CHILDREN = {
    "api_requests": ("ts_ms", "id", "model", "input_tokens", "output_tokens", "cache_read", "cache_creation", "cost_usd", "duration_ms", "is_error", "status_code"),
    "tool_decisions": ("ts_ms", "id", "tool_name", "decision", "source"),
    "tool_results": ("ts_ms", "id", "tool_name", "success", "duration_ms", "bash_command", "mcp_server"),
    "events": ("ts_ms", "id", "name"),
}
#: The session's texts; empty where the session table lacks them.
TEXTS = ("app_version", "model_set", "user_email", "org_id", "token_source")


def export(t: Telemetry) -> DataFrame:
    """id and JSON document of each session: the session, and its children in order of (ts, id), never null."""
    sessions = t.sessions
    texts = [(F.coalesce(c, F.lit("")) if c in sessions.columns else F.lit("")).alias(c) for c in TEXTS]
    flag = F.col("has_events") if "has_events" in sessions.columns else F.lit(None).cast("boolean")
    out = sessions.select("id", F.struct("id", "first_seen", "last_seen", *texts, flag.alias("has_events")).alias("session"))
    for name, columns in CHILDREN.items():
        child = getattr(t, name).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(child.withColumnRenamed("session_id", "id"), "id", "left").withColumn(name, F.coalesce(F.col(name), F.array()))
    # where the session table doesn't say so, a session with any child from a log record has events
    some = F.lit(False)
    for name in CHILDREN:
        some = some | (F.size(name) > 0)
    out = out.withColumn("session", F.col("session").withField("has_events", F.coalesce("session.has_events", some)))
    return out.select("id", F.to_json(F.struct("session", *CHILDREN)).alias("document"))


def export_counts(t: Telemetry) -> DataFrame:
    """What each session's document holds, read back from the JSON."""
    size = lambda name: F.json_array_length(F.get_json_object("document", f"$.{name}")).cast("bigint").alias(name)
    first = F.get_json_object("document", "$.api_requests[0].ts_ms").cast("bigint")
    return export(t).select("id", *map(size, CHILDREN), F.coalesce(first, F.lit(0)).cast("bigint").alias("first_request"))


def export_one(t: Telemetry, session_id: str) -> str:
    """One session's document; NotFound if there's none."""
    require(t, session_id)
    one = lambda rows, key: rows.where(F.col(key) == session_id)
    own = SimpleNamespace(sessions=one(t.sessions, "id"), **{name: one(getattr(t, name), "session_id") for name in CHILDREN})
    return export(own).first()["document"]


def export_fields(t: Telemetry) -> DataFrame:
    """What the documents hold, read back from the JSON: a row for each child, in the document's order."""
    kinds = {"api_requests": "model string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_creation bigint, cost_usd double, duration_ms bigint, is_error boolean, status_code bigint", "tool_decisions": "tool_name string, decision string, source string", "tool_results": "tool_name string, success boolean, duration_ms bigint", "events": "name string"}
    values = {
        "api_requests": ("c.model", "c.input_tokens + c.output_tokens + c.cache_read + c.cache_creation + c.duration_ms + c.status_code", "c.cost_usd", "not c.is_error"),
        "tool_decisions": ("concat_ws('/', c.tool_name, c.decision, c.source)", "0", "0", "true"),
        "tool_results": ("c.tool_name", "c.duration_ms", "0", "c.success"),
        "events": ("c.name", "0", "0", "true"),
    }
    parts = []
    for name, columns in kinds.items():
        fields = ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in f"ts_ms bigint, id bigint, {columns}".split(", "))
        parts.append(f"transform({name}, (c, i) -> named_struct('child', '{name}', 'position', cast(i as bigint), 'ts_ms', c.ts_ms, 'row_id', c.id, 'label', {values[name][0]}, 'amount', cast({values[name][1]} as bigint), 'cost_usd', round(cast({values[name][2]} as double), 6), 'ok', {values[name][3]}))")
        kinds[name] = f"{name} array<struct<{fields}>>"
    return export(t).select("id", F.from_json("document", ", ".join(kinds.values())).alias("d")).select("id", "d.*").select("id", F.expr(f"inline(concat({', '.join(parts)}))"))
