"""Registered queries that take the driver's tables in through the sources, the streams and the stored tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalogue, shared
from .catalogue import ADAPTER, COUNTER, KEYED
from .operators import delta, merge
from .plans import export, sessions, timeline
from .sources import collect, counters, otlp
from .sources.adapter import Telemetry
from .streaming import delta_stream, live, runs
from .streaming.store import Store, Table

_entries: dict[str, tuple[Callable[[Telemetry], DataFrame], str]] = {}


def _said(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))


def _resource(*attributes: Column) -> Column:
    return F.struct(F.array(*attributes).alias("attributes")).alias("resource")


def _documents(rows: DataFrame, document: Column, schema: str) -> DataFrame:
    """Export documents as a collector would have written them."""
    return rows.select(F.from_json(F.to_json(document), schema).alias("d")).select("d.*")


def _metrics(t: Telemetry) -> DataFrame:
    """Metric points as exports; some without a value, some of a shape that isn't taken."""
    value = F.when(F.col("id") % 10 != 3, F.col("value_delta"))
    key = F.when(F.col("name") == "cost.usage", "model").otherwise("type")
    own = F.array(F.struct(key.alias("key"), F.struct(F.col("attr_key").alias("stringValue")).alias("value")))
    point = F.struct(F.when(F.col("attr_key") != "", own).otherwise(F.array()).alias("attributes"), F.lit("1").alias("startTimeUnixNano"), (F.col("ts_ms") * 1_000_000).cast("string").alias("timeUnixNano"), value.alias("asDouble"))
    odd = F.col("id") % 10 == 7
    taken = F.when(~odd, F.struct(F.lit(1).alias("aggregationTemporality"), F.array(point).alias("dataPoints")))
    other = F.when(odd, F.struct(F.array(F.struct(F.lit("5").alias("count"))).alias("dataPoints")))
    metric = F.struct("name", taken.alias("sum"), other.alias("histogram"))
    return _documents(t.metric_points, F.struct(F.array(F.struct(_resource(_said("session.id", F.col("session_id"))), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics")), otlp.METRICS)


def _traces(t: Telemetry) -> DataFrame:
    """Tool results as spans; some without ids."""
    hexed = lambda n: F.when(F.col("id") % 20 != 0, F.lpad(F.hex("id"), n, "0")).otherwise("")
    parent = F.when(F.col("id") % 3 == 0, F.lpad(F.hex(F.col("id") - 1), 16, "0"))
    status = F.when(F.col("id") % 7 != 0, F.struct(F.when(F.col("success"), 1).otherwise(2).alias("code")))
    nano = lambda ms: (ms * 1_000_000).cast("string")
    span = F.struct(hexed(32).alias("traceId"), hexed(16).alias("spanId"), parent.alias("parentSpanId"), F.col("tool_name").alias("name"), nano(F.col("ts_ms")).alias("startTimeUnixNano"), nano(F.col("ts_ms") + F.col("duration_ms")).alias("endTimeUnixNano"), status.alias("status"))
    return _documents(t.tool_results, F.struct(F.array(F.struct(_resource(_said("session_id", F.col("session_id"))), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")), otlp.TRACES)


def _records(rows: DataFrame, name: str, attributes: Column, body: Column) -> DataFrame:
    """Log records as exports, one a row."""
    record = F.struct((F.col("ts_ms") * 1_000_000).cast("string").alias("timeUnixNano"), F.lit(f"claude_code.{name}").alias("eventName"), F.struct(body.alias("stringValue")).alias("body"), attributes.alias("attributes"))
    return _documents(rows, F.struct(F.array(F.struct(_resource(_said("session.id", F.col("session_id"))), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")), otlp.LOGS)


_entries["otlp_metric_points"] = (
    lambda t: collect.collect(metrics=_metrics(t)).metric_points.groupBy("session_id", "name", "attr_key").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value_delta"), 6).alias("total")),
    f"""{ADAPTER} SELECT session_id, name, attr_key, CAST(count(*) AS BIGINT) AS points, round(sum(v), 6) AS total FROM (
  SELECT session_id, name, attr_key, ts_ms, min(value_delta) AS v FROM mp WHERE id % 10 NOT IN (3, 7) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
)
_entries["otlp_spans"] = (
    lambda t: collect.collect(traces=_traces(t)).spans.drop("attrs_json"),
    f"""{ADAPTER} SELECT session_id, lpad(lower(hex(id)), 32, '0') AS trace_id, lpad(lower(hex(id)), 16, '0') AS span_id, CASE WHEN id % 3 = 0 THEN lpad(lower(hex(id - 1)), 16, '0') ELSE '' END AS parent_span_id, tool_name AS name,
  ts_ms AS start_ts, ts_ms + duration_ms AS end_ts, CASE WHEN id % 7 = 0 THEN 'unset' WHEN success THEN 'ok' ELSE 'error' END AS status FROM tr WHERE id % 20 <> 0""",
)

_DEEP = "[" * otlp.MOST_DEPTH + f'"{otlp.TRUNCATED}:depth_exceeded"' + "]" * otlp.MOST_DEPTH


def _nested(t: Telemetry) -> DataFrame:
    """Events whose attributes hold lists and maps, one of them deeper than what is kept."""
    wire = '{"values":[{"intValue":"%d"},{"stringValue":"a \\"b\\""},{"kvlistValue":{"values":[{"key":"z","value":{"boolValue":true}},{"key":"a","value":{"doubleValue":0.5}},{"key":"z","value":{}}]}}]}'
    deep = '{"values":[' + '{"arrayValue":{"values":[' * 10 + '{"intValue":1}' + "]}}" * 10 + "]}"
    attributes = f'[{{"key":"list","value":{{"arrayValue":{wire}}}}},{{"key":"deep","value":{{"arrayValue":{deep}}}}},{{"key":"k","value":{{"intValue":"%d"}}}}]'
    record = f'{{"timeUnixNano":"%d","eventName":"note","body":{{"stringValue":"%d"}},"attributes":{attributes}}}'
    document = f'{{"resourceLogs":[{{"resource":{{"attributes":[{{"key":"session.id","value":{{"stringValue":"%s"}}}}]}},"scopeLogs":[{{"logRecords":[{record}]}}]}}]}}'
    k = F.get_json_object("attrs_json", "$.prompt_length").cast("bigint")
    rows = t.events.select(F.format_string(document, "session_id", F.col("ts_ms") * 1_000_000, "id", k, k).alias("value"))
    logs = rows.select(F.from_json("value", otlp.LOGS).alias("d")).select("d.*")
    return collect.collect(logs=logs).events.select("session_id", "ts_ms", "attrs_json")


def _error_texts(t: Telemetry) -> DataFrame:
    failed = t.api_requests.where("is_error")
    text = F.concat(F.lit("overloaded "), "k")
    attributes = F.array(F.struct(F.when(F.col("k") % 3 == 0, "error").when(F.col("k") % 3 == 1, "error_message").otherwise("note").alias("key"), F.struct(text.alias("stringValue")).alias("value")), _said("input_tokens", F.col("id")))
    rows = collect.collect(logs=_records(failed, "api_error", attributes, F.lit(""))).api_requests
    return timeline.error_texts(rows).select("session_id", "ts_ms", "input_tokens", "is_error", "error")


_entries["otlp_error_texts"] = (_error_texts, f"{ADAPTER} SELECT session_id, ts_ms, id AS input_tokens, is_error, CASE WHEN k % 3 < 2 THEN 'overloaded ' || k END AS error FROM api WHERE is_error")
_entries["event_tail_fields"] = (lambda t: t.events.select("id", timeline.tail_fields(F.col("attrs_json")).alias("fields")), f"""{ADAPTER} SELECT id, '{{"prompt_length":' || k || '}}' AS fields FROM ev""")
_entries["export_document_fields"] = (
    export.export_fields,
    f"""{ADAPTER} SELECT session_id AS id, child, row_number() OVER (PARTITION BY session_id, child ORDER BY ts_ms, row_id) - 1 AS position, ts_ms, row_id, label, amount, round(cost, 6) AS cost_usd, ok FROM (
  SELECT session_id, 'api_requests' AS child, ts_ms, id AS row_id, model AS label, input_tokens + output_tokens + cache_read + cache_creation + duration_ms + status_code AS amount, cost_usd AS cost, NOT is_error AS ok FROM api
  UNION ALL SELECT session_id, 'tool_decisions', ts_ms, id, tool_name || '/' || decision || '/' || source, 0, 0, TRUE FROM td
  UNION ALL SELECT session_id, 'tool_results', ts_ms, id, tool_name, duration_ms, 0, success FROM tr
  UNION ALL SELECT session_id, 'events', ts_ms, id, 'user_prompt', 0, 0, TRUE FROM ev)""",
)
_entries["known_sessions"] = (
    lambda t: sessions.known_sessions(t, t.events_base.select(F.concat(F.lit("u"), F.col("u") * 2).alias("id")).distinct()),
    f"{ADAPTER} SELECT DISTINCT 'u' || (u * 2) AS id, 'u' || (u * 2) IN (SELECT id FROM s) AS found FROM base",
)


_entries["session_snapshots"] = (
    lambda t: sessions.snapshots(t).select("id", "cost_usd", "input_tokens", "output_tokens", "cache_hit_ratio", "tool_accept", "tool_reject", "auto_approved", "last_tool"),
    f"""{ADAPTER} SELECT sl.id, cost_usd, input_tokens, output_tokens, round(CASE WHEN input_tokens + cache_read > 0 THEN cache_read / (input_tokens + cache_read) ELSE 0 END, 6) AS cache_hit_ratio, tool_accept, tool_reject,
  CAST(coalesce(a.n, 0) AS BIGINT) AS auto_approved, coalesce(a.tool, '') AS last_tool FROM sl
  LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE decision = 'accept' AND source IN ('config', 'hook')) AS n, arg_max(tool_name, {{'t': ts_ms, 'i': id}}) AS tool FROM td GROUP BY 1) a ON a.session_id = sl.id""",
)
_entries["log_rows"] = (
    lambda t: timeline.log_rows(t).select("session_id", "ts_ms", "id", "kind", F.coalesce("model", "tool_name", F.lit("")).alias("label"), F.coalesce("prompt_length", "status_code", F.lit(0)).alias("number")),
    f"""{ADAPTER} SELECT session_id, ts_ms, id, 'user_prompt' AS kind, '' AS label, k AS number FROM ev UNION ALL SELECT session_id, ts_ms, id, CASE WHEN is_error THEN 'api_error' ELSE 'api_request' END, model, status_code FROM api
UNION ALL SELECT session_id, ts_ms, id, 'tool_decision', tool_name, 0 FROM td UNION ALL SELECT session_id, ts_ms, id, 'tool_result', tool_name, 0 FROM tr""",
)


def _health(t: Telemetry) -> DataFrame:
    lines = catalogue.transcript_lines(t)
    broken = t.api_requests.where("not is_error and k % 7 = 0").select(F.col("session_id").alias("file"), (F.col("id") * 3).alias("pos"), F.lit('{"type": "assist').alias("value"))
    counts = collect.collect(lines.unionByName(broken), _metrics(t), catalogue.request_logs(t)).counts
    return counters.health(t.events_base.sparkSession, counts, counters.policy(90, 1000))


_entries["ingest_health"] = (
    _health,
    f"""{ADAPTER}, q AS (SELECT count(*) AS n, count(*) FILTER (WHERE k % 2 = 0) AS r, count(*) FILTER (WHERE k % 5 = 0) AS p, count(*) FILTER (WHERE k % 3 = 0) AS l, count(*) FILTER (WHERE k % 7 = 0) AS m FROM api WHERE NOT is_error),
x AS (SELECT count(*) AS n, count(*) FILTER (WHERE id % 10 = 3) AS v, count(*) FILTER (WHERE id % 10 = 7) AS s FROM mp)
SELECT 'ok' AS status, CAST(q.n + r + p + m + l + x.n AS BIGINT) AS received, CAST(2 * q.n + r + p + l + x.n - v - s AS BIGINT) AS accepted, CAST(m + v + s AS BIGINT) AS rejected_permanent, CAST(s AS BIGINT) AS unsupported_shape, CAST(v AS BIGINT) AS no_value,
  CAST(0 AS BIGINT) AS not_finite, CAST(m AS BIGINT) AS malformed, '90d or 1000 sessions' AS policy FROM q, x""",
)


def _thirds(t: Telemetry) -> list[Column]:
    """Conditions on the events' ids that cut them into three runs."""
    most = t.events_base.agg(F.max("id")).first()[0] or 0
    a, b = most // 3, 2 * most // 3
    at = F.col("arrival_seq")
    return [at <= a, (at > a) & (at <= b), at > b]


def _followed_live(t: Telemetry) -> DataFrame:
    """The last tick of each session, as its own viewer's, after three starts on one checkpoint."""
    spark = t.events_base.sparkSession
    none = {"dedup_key": F.concat(F.lit("r"), "id"), "cost_usd": F.lit(0.0), "tokens": F.lit(0), "cost_source": F.lit(""), "tool_name": F.lit(""), "value": F.lit(0.0)}

    def kind(rows: DataFrame, name: str, **own: Column) -> DataFrame:
        values = {c: own.get(c, v) for c, v in none.items()}
        kinds = {"dedup_key": "string", "cost_usd": "double", "tokens": "bigint", "cost_source": "string", "tool_name": "string", "value": "double"}
        return rows.select(F.col("session_id").alias("who"), F.lit(name).alias("kind"), "session_id", F.col("id").alias("arrival_seq"), "ts_ms", *(v.cast(kinds[c]).alias(c) for c, v in values.items()))

    requests = catalogue.keyed_requests(t).withColumnRenamed("arrival_seq", "id")
    rows = kind(requests, "api", dedup_key=F.col("dedup_key"), cost_usd=F.col("cost_usd"), tokens=F.col("input_tokens") + F.col("output_tokens"), cost_source=F.col("cost_source"))
    for part in (kind(t.tool_decisions, "decision", tool_name=F.col("tool_name")), kind(t.tool_results, "result", tool_name=F.col("tool_name")), kind(t.metric_points.where("name = 'active_time.total'"), "metric", value=F.col("value_delta"))):
        rows = rows.unionByName(part)
    folder = shared.new_folder(spark, "live")
    last = Table(("who",), lambda held: held.groupBy("who").agg(F.max_by(F.struct(*(c for c in held.columns if c != "who")), "arrival_seq").alias("l")).select("who", "l.*").select(*held.columns))
    store = Store(spark, f"{folder}-store", {"live": last})

    def keep(batch: DataFrame, number: int) -> None:
        store.write(number, {"live": batch.where("kind = 'tick'").withColumn("arrival_seq", F.lit(number).cast("long"))})

    for third in _thirds(t):
        rows.where(third).write.mode("append").parquet(folder)
        ticks = live.live_view(spark.readStream.schema(rows.schema).parquet(folder))
        runs.run_available(spark, ticks.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}-progress"))
    return store.read("live").select(F.col("who").alias("session_id"), F.round("cost_usd", 6).alias("cost_usd"), "tokens", F.round("active_sec", 6).alias("active_sec"), "last_tool")


_entries["live_snapshots"] = (
    _followed_live,
    f"""{KEYED}, o AS (SELECT session_id, dedup_key, arg_min(cost_usd, {{'p': CASE WHEN cost_source = 'otlp' THEN 0 ELSE 1 END, 'i': id}}) AS c, arg_min(input_tokens + output_tokens, {{'p': CASE WHEN cost_source = 'otlp' THEN 0 ELSE 1 END, 'i': id}}) AS n FROM kd GROUP BY 1, 2),
a AS (SELECT session_id, sum(c) AS c, sum(n) AS n FROM o GROUP BY 1), m AS (SELECT session_id, sum(value_delta) AS v FROM mp WHERE name = 'active_time.total' GROUP BY 1),
l AS (SELECT session_id, arg_max(tool_name, id) AS tool FROM (SELECT session_id, tool_name, id FROM td UNION ALL SELECT session_id, tool_name, id FROM tr) GROUP BY 1),
w AS (SELECT session_id FROM a UNION SELECT session_id FROM m UNION SELECT session_id FROM l)
SELECT session_id, round(coalesce(c, 0), 6) AS cost_usd, CAST(coalesce(n, 0) AS BIGINT) AS tokens, round(coalesce(v, 0), 6) AS active_sec, coalesce(tool, '') AS last_tool FROM w LEFT JOIN a USING (session_id) LEFT JOIN m USING (session_id) LEFT JOIN l USING (session_id)""",
)


def _stored(t: Telemetry) -> DataFrame:
    """Rows of the stored tables after three batches and retention: 7 days, 50 sessions."""
    spark = t.events_base.sparkSession
    store = Store(spark, shared.new_folder(spark, "store"), bucket_rows=100_000)
    about = t.events_base.select(F.col("session_id").alias("id"), "ts_ms", F.col("id").alias("arrival_seq"))
    requests, results = catalogue.keyed_requests(t).drop("k"), t.tool_results.withColumn("dedup_key", F.concat(F.lit("r"), "id")).withColumnRenamed("id", "arrival_seq")
    for number, third in enumerate(_thirds(t)):
        seen = about.where(third).groupBy("id").agg(F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"), F.max("arrival_seq").alias("arrival_seq"))
        store.write(number, {"sessions": seen, "api_requests": requests.where(third), "tool_results": results.where(third)})
    now = store.read("sessions").agg(F.max("last_seen")).first()[0] or 0
    store.retain(now, 7 * catalogue.DAY_MS, 50)
    count = lambda name, key: store.read(name).groupBy(F.col(key).alias("session_id")).agg(F.count(F.lit(1)).alias("rows")).select("session_id", F.lit(name).alias("stored"), "rows")
    return count("sessions", "id").unionByName(count("api_requests", "session_id")).unionByName(count("tool_results", "session_id"))


_entries["stored_tables_retained"] = (
    _stored,
    f"""{KEYED}, keep AS (SELECT id FROM s WHERE last_seen >= (SELECT max(last_seen) FROM s) - 7 * 86400000 ORDER BY last_seen DESC, id DESC LIMIT 50)
SELECT id AS session_id, 'sessions' AS stored, CAST(1 AS BIGINT) AS rows FROM keep UNION ALL SELECT session_id, 'api_requests', CAST(count(DISTINCT dedup_key) AS BIGINT) FROM kd WHERE session_id IN (SELECT id FROM keep) GROUP BY 1
UNION ALL SELECT session_id, 'tool_results', CAST(count(*) AS BIGINT) FROM tr WHERE session_id IN (SELECT id FROM keep) GROUP BY 1""",
)


def _seeded(t: Telemetry) -> DataFrame:
    """Deltas of a batch's points, and of a stream that takes up its cursors and goes on over two starts."""
    spark = t.events_base.sparkSession
    points = t.raw_counter.select("series", "arrival", "time_ms", "start_ms", "value", F.lit(2).alias("temporality"))
    first = points.where("arrival <= 5")
    folder = shared.new_folder(spark, "points")
    for part in ("arrival > 5 and arrival <= 12", "arrival > 12"):
        points.where(part).write.mode("append").parquet(folder)
        deltas = delta_stream.normalize_stream(spark.readStream.schema(points.schema).parquet(folder), delta.cursors(first))
        runs.run_available(spark, deltas.writeStream.format("parquet").option("path", f"{folder}-deltas").option("checkpointLocation", f"{folder}-progress"))
    columns = ["series", "time_ms", "value", "delta", "rule"]
    return delta.normalize(first).select(*columns).unionByName(spark.read.schema(delta_stream.OUT).parquet(f"{folder}-deltas").select(*columns))


_entries["stream_deltas_seeded"] = (
    _seeded,
    f"""{COUNTER} SELECT series, time_ms, value, CASE WHEN pv IS NULL THEN 0 WHEN start_ms <> ps OR value < pv THEN value ELSE value - pv END AS delta,
  CASE WHEN pv IS NULL THEN 'baseline' WHEN start_ms <> ps OR value < pv THEN 'reset' ELSE 'normal' END AS rule FROM lagged""",
)
_entries["otlp_nested_attrs"] = (_nested, f"""{ADAPTER} SELECT session_id, ts_ms, '{{"deep":{_DEEP},"k":' || k || ',"list":[' || k || ',"a \\"b\\"",{{"a":0.5,"z":null}}]}}' AS attrs_json FROM ev""")


def _query(of: Callable[[Telemetry], DataFrame]):
    return lambda spark, sf_dir: of(Telemetry.of(spark, sf_dir))


QUERIES = {name: _query(of) for name, (of, _) in _entries.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _entries.items()}
