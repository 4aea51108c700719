"""Transcripts and OTLP/JSON exports, merged to the telemetry tables that the plans read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators import delta, merge
from . import otlp, transcript
from .counters import of_logs, of_metrics, of_transcripts


@dataclass
class Collected:
    """Lazy tables; the plans take this wherever they take the driver tables' Telemetry."""

    api_requests: DataFrame
    metric_points: DataFrame
    tool_decisions: DataFrame
    tool_results: DataFrame
    events: DataFrame
    spans: DataFrame
    sessions: DataFrame
    counts: dict[tuple[str, str], int]


def _named(rows: DataFrame) -> DataFrame:
    """With an id that follows from the dedup key, so that it is the same in each run."""
    return rows.withColumn("id", F.xxhash64("dedup_key"))


def _arrived(rows: DataFrame | None, rank: int) -> DataFrame | None:
    """Rows in an order of arrival: transcripts before exports, then by time; ties go by the whole row."""
    if rows is None:
        return None
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "struct"))]
    return rows.withColumn("arrival_seq", F.struct(F.lit(rank), F.col("ts_ms"), F.xxhash64(*plain)))


def _either(one: DataFrame | None, two: DataFrame | None, columns: str) -> DataFrame:
    """Both, as far as they are there, with the given columns and defaults for those that a source lacks."""
    wanted = [c.split() for c in columns.split(", ")]
    zero = {"string": F.lit(""), "bigint": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False)}
    parts = [p.select("arrival_seq", *((F.col(c) if c in p.columns else zero[t]).cast(t).alias(c) for c, t in wanted)) for p in (one, two) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def collect(lines: DataFrame | None = None, metrics: DataFrame | None = None, logs: DataFrame | None = None, traces: DataFrame | None = None, store_prompts: bool = True) -> Collected:
    """Tables of transcript lines (file, pos, value) and of OTLP export documents (as otlp.read() gives them); at least one of them.

    Each line and document is parsed once, into rows of the shared folder by what they are; the tables are lazy, and each reads only its kinds.
    Equal dedup keys are one row: requests by cost authority, all others by their first arrival. Every session that a child names has a row.
    """
    spark: SparkSession = next(x for x in (lines, logs, metrics, traces) if x is not None).sparkSession
    if lines is None and logs is None:
        logs = spark.createDataFrame([], otlp.LOGS)
    counts: dict[tuple[str, str], int] = {}

    def staged(rows: DataFrame, what: str, counters: dict) -> DataFrame:
        table, seen = shared.by_kind(rows, what, counters)
        counts.update(seen)
        return table

    decoded = None if lines is None else staged(transcript.decode(lines), "transcripts", of_transcripts())
    records = None if logs is None else staged(otlp.log_records(logs), "logs", of_logs())
    of = lambda source, make, rank, *more: None if source is None else _arrived(make(source, *more), rank)
    requests = _either(
        of(decoded, transcript.api_requests, 0), of(records, otlp.api_requests, 1, store_prompts),
        "dedup_key string, session_id string, ts_ms bigint, model string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_creation bigint, cost_usd double, duration_ms bigint, is_error boolean, status_code bigint, cost_source string, attrs_json string",
    )
    results = _either(
        of(decoded, transcript.tool_results, 0, store_prompts), of(records, otlp.tool_results, 1, store_prompts),
        "dedup_key string, session_id string, ts_ms bigint, tool_name string, success boolean, duration_ms bigint, bash_command string, mcp_server string, attrs_json string",
    )
    events = _either(of(decoded, transcript.user_prompts, 0, store_prompts), of(records, otlp.generic_events, 1, store_prompts), "dedup_key string, session_id string, ts_ms bigint, name string, attrs_json string")
    decisions = of(records, otlp.tool_decisions, 1, store_prompts)
    if decisions is None:
        decisions = spark.createDataFrame([], "dedup_key string, session_id string, ts_ms bigint, tool_name string, decision string, source string, attrs_json string, arrival_seq int")
    first = lambda rows: _named(merge.insert_ignore(rows, ["dedup_key"]))
    accepted = None if metrics is None else staged(otlp.metric_rows(metrics), "metrics", of_metrics()).where("kind = 'accepted'")
    points = _deltas(accepted) if accepted is not None else spark.createDataFrame([], "id bigint, session_id string, ts_ms bigint, name string, attr_key string, value_delta double, series_key string")
    requests = _named(merge.cost_authority(requests))
    tables = {"tool_decisions": first(decisions), "tool_results": first(results), "events": first(events)}
    seen = []
    if decoded is not None:
        seen.append(transcript.sessions(decoded).withColumn("arrival_seq", F.lit(0)))
    if records is not None or accepted is not None:
        empty = lambda there: there.where("false").select("session_id", "ts_ms", "name", "about")
        seen.append(otlp.sessions(accepted if accepted is not None else empty(records), records if records is not None else empty(accepted)).withColumn("arrival_seq", F.lit(1)))
    rows = seen[0]
    for more in seen[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    # an unknown time is 0 and loses against any known one
    rows = rows.withColumn("first_seen", F.when(F.col("first_seen") > 0, F.col("first_seen")))
    sessions = merge.merge_sessions(rows).withColumn("first_seen", F.coalesce("first_seen", F.lit(0)))
    sessions = merge.with_missing_sessions(sessions, requests, points, *tables.values())
    spans = otlp.spans(traces, store_prompts) if traces is not None else spark.createDataFrame([], "session_id string, trace_id string, span_id string, parent_span_id string, name string, start_ts bigint, end_ts bigint, status string, attrs_json string")
    return Collected(requests, points, spans=spans, sessions=sessions, counts=counts, **tables)


def _deltas(points: DataFrame) -> DataFrame:
    """Accepted points as growth, once each by (series, start, time); gauges count as they are. Times are compared in nanoseconds."""
    arrived = points.select("session_id", "ts_ms", "name", "attr_key", "value_kind", "temporality", "value", F.col("series_key").alias("series"), F.col("start_ns").alias("start_ms"), F.col("time_ns").alias("time_ms"), "attrs_json")
    arrived = merge.insert_ignore(arrived.withColumn("arrival", F.struct("time_ms", "start_ms", "value")), ["series", "start_ms", "time_ms"], "arrival")
    gauges = arrived.where("value_kind = 1").withColumn("delta", F.col("value")).withColumn("rule", F.lit("gauge"))
    sums = arrived.where("value_kind = 0").withColumn("arrival", F.row_number().over(delta.arrival_window("arrival")).cast("double"))
    rows = gauges.drop("arrival").unionByName(delta.normalize_mixed(sums).drop("arrival"))
    return rows.select(F.xxhash64("series", "start_ms", "time_ms").alias("id"), "session_id", "ts_ms", "name", "attr_key", F.col("delta").alias("value_delta"), F.col("series").alias("series_key"), "value_kind", F.col("start_ms").alias("start_ns"), F.col("time_ms").alias("time_ns"), "attrs_json")


def from_folders(spark: SparkSession, transcripts: str | None = None, metrics: str | None = None, logs: str | None = None, traces: str | None = None, store_prompts: bool = True) -> Collected:
    """collect() of folders: transcripts (*.jsonl at any depth), and OTLP/JSON exports, one document a line."""
    export = lambda path, schema: None if path is None else otlp.read(spark, path, schema)
    lines = None if transcripts is None else transcript.read_lines(spark, transcripts)
    return collect(lines, export(metrics, otlp.METRICS), export(logs, otlp.LOGS), export(traces, otlp.TRACES), store_prompts)
