"""The registered queries on the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .functions import keys, pricing
from .operators import axis, delta, merge, pairing
from .plans import cost, daily, export, sessions, timeline, tools
from .sources import append_jsonl, collect, otlp, transcript
from .sources.adapter import Telemetry
from .streaming import pair_stream, runs

#: A time in the driver's events, used as `now` and `since`.
DAY_MS = 86_400_000
#: Starts of a streaming query on one checkpoint.
STARTS = 3

ADAPTER = """
WITH base AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, user_id AS u, event_type AS et, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    'u' || user_id AS session_id, user_id % 10 <> 9 AND user_id % 4 <> 3 AS event_axis, user_id % 10 <> 9 AND user_id % 4 IN (2, 3) AS metric_axis
  FROM events),
named AS (
  SELECT *, ['claude-opus-4', 'claude-sonnet-4', 'claude-haiku-4', 'other-model'][k % 4 + 1] AS model,
    ['Bash', 'Edit', 'Read', 'Write', 'Grep', 'WebFetch', 'mcp__srv__run'][k % 7 + 1] AS tool,
    ['config', 'hook', 'user_temporary', 'user_permanent'][k % 4 + 1] AS src FROM base),
api AS (
  SELECT id, session_id, ts_ms, model, CASE WHEN et = 'error' THEN 0 ELSE k * 10 END AS input_tokens, CASE WHEN et = 'error' THEN 0 ELSE k * 3 END AS output_tokens,
    CASE WHEN et = 'error' THEN 0 ELSE k % 5 * 200 END AS cache_read, CASE WHEN et = 'error' THEN 0 ELSE k % 7 * 50 END AS cache_creation,
    CASE WHEN et = 'error' THEN 0.0::DOUBLE ELSE value / 1000 END AS cost_usd, CASE WHEN et = 'error' THEN 0 ELSE k * 20 END AS duration_ms, et = 'error' AS is_error,
    CASE WHEN et = 'error' THEN 529 ELSE 0 END AS status_code, CASE WHEN k % 3 = 0 THEN 'otlp' ELSE 'jsonl-estimate' END AS cost_source, k
  FROM named WHERE event_axis AND et IN ('purchase', 'error')),
mp AS (
  SELECT id, session_id, ts_ms, p.name AS name, p.attr_key AS attr_key, p.v AS value_delta FROM (
    SELECT id, session_id, ts_ms, unnest([
      {'name': 'cost.usage', 'attr_key': model, 'v': value / 1000}, {'name': 'token.usage', 'attr_key': 'input', 'v': (k * 10)::DOUBLE},
      {'name': 'token.usage', 'attr_key': 'output', 'v': (k * 3)::DOUBLE}, {'name': 'token.usage', 'attr_key': 'cacheRead', 'v': (k % 5 * 200)::DOUBLE},
      {'name': 'token.usage', 'attr_key': 'cacheCreation', 'v': (k % 7 * 50)::DOUBLE}, {'name': 'active_time.total', 'attr_key': '', 'v': k::DOUBLE}]) AS p
    FROM named WHERE metric_axis AND et = 'purchase')),
td AS (SELECT id, session_id, ts_ms, CASE WHEN k % 6 = 0 THEN 'reject' ELSE 'accept' END AS decision, src AS source, tool AS tool_name FROM named WHERE et = 'click'),
tr AS (SELECT id, session_id, ts_ms, tool AS tool_name, k % 9 <> 0 AS success, k * 15 AS duration_ms, k FROM named WHERE et = 'view'),
ev AS (SELECT id, session_id, ts_ms, k, CASE WHEN k % 2 = 0 THEN 'p' || k ELSE '' END AS prompt FROM named WHERE et = 'signup'),
ms AS (
  SELECT session_id, string_agg(model, ',' ORDER BY ts_ms, id) AS model_set FROM (
    SELECT session_id, model, ts_ms, id, row_number() OVER (PARTITION BY session_id, model ORDER BY ts_ms, id) AS n FROM api) WHERE n = 1 GROUP BY 1),
s AS (
  SELECT b.session_id AS id, b.first_seen, b.last_seen, coalesce(ms.model_set, '') AS model_set
  FROM (SELECT session_id, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen FROM base GROUP BY 1) b LEFT JOIN ms USING (session_id)),
mo AS (SELECT * FROM mp WHERE session_id NOT IN (SELECT session_id FROM api)),
ea AS (SELECT session_id, sum(cost_usd) c, sum(input_tokens) i, sum(output_tokens) o, sum(cache_read) cr, sum(cache_creation) cc FROM api GROUP BY 1),
ma AS (
  SELECT session_id, sum(CASE WHEN name = 'cost.usage' THEN value_delta ELSE 0 END) c, trunc(sum(CASE WHEN attr_key = 'input' THEN value_delta ELSE 0 END)) i,
    trunc(sum(CASE WHEN attr_key = 'output' THEN value_delta ELSE 0 END)) o, trunc(sum(CASE WHEN attr_key = 'cacheRead' THEN value_delta ELSE 0 END)) cr,
    trunc(sum(CASE WHEN attr_key = 'cacheCreation' THEN value_delta ELSE 0 END)) cc FROM mp WHERE name IN ('cost.usage', 'token.usage') GROUP BY 1),
ta AS (SELECT session_id, count(*) FILTER (WHERE decision = 'accept') a, count(*) FILTER (WHERE decision = 'reject') r FROM td GROUP BY 1),
sl AS (
  SELECT s.id, s.first_seen, s.last_seen, s.model_set, CASE WHEN ea.session_id IS NOT NULL THEN 'events' WHEN ma.session_id IS NOT NULL THEN 'metrics' ELSE '' END AS token_source,
    round(coalesce(ea.c, ma.c, 0), 6) AS cost_usd, CAST(coalesce(ea.i, ma.i, 0) AS BIGINT) AS input_tokens, CAST(coalesce(ea.o, ma.o, 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(ea.cr, ma.cr, 0) AS BIGINT) AS cache_read, CAST(coalesce(ea.cc, ma.cc, 0) AS BIGINT) AS cache_creation,
    CAST(coalesce(ta.a, 0) AS BIGINT) AS tool_accept, CAST(coalesce(ta.r, 0) AS BIGINT) AS tool_reject, round(greatest(0, (last_seen - first_seen) / 1000), 6) AS duration_sec,
    round(CASE WHEN coalesce(ta.a + ta.r, 0) > 0 THEN ta.a / (ta.a + ta.r) ELSE 0 END, 6) AS tool_accept_rate
  FROM s LEFT JOIN ea ON ea.session_id = s.id LEFT JOIN ma ON ma.session_id = s.id LEFT JOIN ta ON ta.session_id = s.id)
"""


def _series_sql(width: int, requests: str = "TRUE", points: str = "TRUE") -> str:
    return f"""{ADAPTER}, parts AS (
  SELECT ts_ms // {width} * {width} AS ts, sum(cost_usd) c, sum(input_tokens) i, sum(output_tokens) o, sum(cache_read) cr, sum(cache_creation) cc, FALSE AS m FROM api WHERE {requests} GROUP BY 1
  UNION ALL
  SELECT ts_ms // {width} * {width}, sum(CASE WHEN name = 'cost.usage' THEN value_delta ELSE 0 END), trunc(sum(CASE WHEN attr_key = 'input' THEN value_delta ELSE 0 END)),
    trunc(sum(CASE WHEN attr_key = 'output' THEN value_delta ELSE 0 END)), trunc(sum(CASE WHEN attr_key = 'cacheRead' THEN value_delta ELSE 0 END)),
    trunc(sum(CASE WHEN attr_key = 'cacheCreation' THEN value_delta ELSE 0 END)), TRUE FROM mo WHERE name IN ('cost.usage', 'token.usage') AND {points} GROUP BY 1),
series AS (
  SELECT ts, sum(c) AS c, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(cr) AS BIGINT) AS cache_read, CAST(sum(cc) AS BIGINT) AS cache_creation FROM parts GROUP BY 1)
"""


_SERIES_OUT = "SELECT ts, round(c, 6) AS cost_usd, input_tokens, output_tokens, cache_read, cache_creation, round(sum(c) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS cumulative_usd FROM series"
_MODELS = """, bm AS (SELECT model, sum(c) AS c, CAST(sum(t) AS BIGINT) AS tokens FROM (
  SELECT model, cost_usd AS c, input_tokens + output_tokens AS t FROM api UNION ALL SELECT attr_key, value_delta, 0 FROM mo WHERE name = 'cost.usage') GROUP BY 1)
SELECT model, round(c, 6) AS cost_usd, tokens, round(CASE WHEN sum(c) OVER () > 0 THEN c / sum(c) OVER () ELSE 0 END, 6) AS pct FROM bm"""
_HOUR, _DAY = cost.WIDTHS["hour"], cost.WIDTHS["day"]
_OPUS = "claude-opus-4"
_DAILY = f"""{_series_sql(_HOUR)}, d AS (
  SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS day, sum(input_tokens + output_tokens) AS tokens, sum(round(c, 6)) AS c FROM series GROUP BY 1),
g AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day),
f AS (SELECT g.day, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, round(coalesce(c, 0), 6) AS cost_usd FROM g LEFT JOIN d USING (day)),
p AS (SELECT list_sort(list(tokens)) AS p FROM f WHERE tokens > 0)
"""
_TIMELINE = f"""{ADAPTER}, tl AS (
  SELECT session_id, ts_ms, id, 0 AS seq, 'prompt' AS kind, prompt AS label, k AS amount FROM ev
  UNION ALL SELECT session_id, ts_ms, id, 1, CASE WHEN is_error THEN 'api_error' ELSE 'api' END, model, input_tokens + output_tokens FROM api
  UNION ALL SELECT session_id, ts_ms, id, 2, 'decision', tool_name || ':' || decision, 0 FROM td
  UNION ALL SELECT session_id, ts_ms, id, 3, 'result', tool_name, duration_ms FROM tr)
"""
COUNTER = f"""{ADAPTER}, c0 AS (
  SELECT session_id, id, ts_ms, k, row_number() OVER w AS n, sum(CASE WHEN k % 25 = 0 THEN 1 ELSE 0 END) OVER w AS epoch FROM named WHERE metric_axis AND et = 'purchase' WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, id)),
raw AS (
  SELECT session_id AS series, id, ts_ms AS time_ms, min(ts_ms) OVER (PARTITION BY session_id, epoch) AS start_ms,
    CAST(sum(k * 10) OVER (PARTITION BY session_id, epoch ORDER BY ts_ms, id) AS DOUBLE) AS value, n + CASE WHEN k % 11 = 0 THEN 3.5 ELSE 0 END AS arrival FROM c0),
hw AS (SELECT *, max(time_ms) OVER (PARTITION BY series ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM raw),
lagged AS (SELECT *, lag(value) OVER w AS pv, lag(start_ms) OVER w AS ps FROM hw WHERE high IS NULL OR time_ms >= high WINDOW w AS (PARTITION BY series ORDER BY arrival))
"""

Query = Callable[[SparkSession, str], DataFrame]
_entries: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Callable[[Telemetry], DataFrame], sql: str | None) -> None:
    _entries[name] = (lambda spark, sf_dir: query(Telemetry.of(spark, sf_dir)), sql)


_LIST = "id, first_seen, last_seen, model_set, token_source, cost_usd, input_tokens, output_tokens, cache_read, cache_creation, tool_accept, tool_reject, duration_sec, tool_accept_rate"
_add("sessions_list", sessions.session_list, f"{ADAPTER} SELECT {_LIST} FROM sl")
_add("sessions_page_by_cost", lambda t: sessions.session_page(t, "cost", limit=20, offset=10), f"{ADAPTER} SELECT {_LIST} FROM sl ORDER BY cost_usd DESC, id LIMIT 20 OFFSET 10")
_add("sessions_page_by_tokens", lambda t: sessions.session_page(t, "tokens", ascending=True, limit=20), f"{ADAPTER} SELECT {_LIST} FROM sl ORDER BY input_tokens + output_tokens, id LIMIT 20")
_add("sessions_prefix_search", lambda t: sessions.session_list(t, prefix="U1"), f"{ADAPTER} SELECT {_LIST} FROM sl WHERE lower(id) LIKE 'u1%'")
_add("sessions_total", lambda t: t.sessions.agg(F.count(F.lit(1)).alias("total")), f"{ADAPTER} SELECT CAST(count(*) AS BIGINT) AS total FROM s")
_add("session_model_breakdown", sessions.model_breakdown, f"{ADAPTER} SELECT session_id, model, CAST(sum(t) AS BIGINT) AS tokens, round(sum(c), 6) AS cost_usd FROM (SELECT session_id, model, cost_usd c, input_tokens + output_tokens t FROM api UNION ALL SELECT session_id, attr_key, value_delta, 0 FROM mo WHERE name = 'cost.usage') GROUP BY 1, 2")
_add("latest_session", sessions.latest_session, f"{ADAPTER} SELECT id, first_seen, last_seen, model_set FROM s ORDER BY last_seen DESC, id LIMIT 1")
_add("last_tool", sessions.latest_tools, f"{ADAPTER} SELECT session_id, ts_ms, tool_name FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) AS n FROM td) WHERE n = 1")
_add("active_time", sessions.active_time, f"{ADAPTER} SELECT session_id, round(sum(value_delta), 6) AS active_sec FROM mp WHERE name = 'active_time.total' GROUP BY 1")

_add("cost_series_hour", lambda t: cost.cost_series(t, "hour"), _series_sql(_HOUR) + _SERIES_OUT)
_add("cost_series_day", lambda t: cost.cost_series(t, "day"), _series_sql(_DAY) + _SERIES_OUT)
_add("cost_filtered_model", lambda t: cost.cost_series(t, "day", model=_OPUS), _series_sql(_DAY, f"model = '{_OPUS}'", f"(name = 'token.usage' OR attr_key = '{_OPUS}')") + _SERIES_OUT)
_add("cost_by_model", cost.cost_by_model, ADAPTER + _MODELS)
_add("cost_rollup", cost.cost_rollup, f"""{_series_sql(_HOUR)}, one AS (
  SELECT sum(c) AS total, sum(input_tokens + output_tokens + cache_read + cache_creation) AS tok, (max(ts) + {_HOUR} - min(ts)) / 60000 AS minutes, sum(input_tokens) AS i, sum(cache_read) AS cr FROM series),
saved AS (SELECT sum(CASE WHEN model LIKE '%opus%' THEN 13.5 WHEN model LIKE '%sonnet%' THEN 2.7 WHEN model LIKE '%haiku%' THEN 0.9 END / 1e6 * cr) AS v FROM (SELECT model, sum(cache_read) AS cr FROM api GROUP BY 1) WHERE cr > 0)
SELECT round(coalesce(total, 0), 6) AS total_cost_usd, round(coalesce(total / minutes, 0), 6) AS burn_usd_per_min, round(coalesce(tok / minutes, 0), 6) AS burn_tok_per_min,
  round(CASE WHEN i + cr > 0 THEN cr / (i + cr) ELSE 0 END, 6) AS cache_hit_ratio, round(CAST(v AS DOUBLE), 6) AS cache_saved_usd, coalesce(cr, 0) > 0 AS cache_saved_estimated,
  CASE WHEN (SELECT bool_or(m) AND bool_or(NOT m) FROM parts) THEN 'mixed' WHEN (SELECT bool_or(NOT m) FROM parts) THEN 'events' WHEN (SELECT bool_or(m) FROM parts) THEN 'metrics' ELSE '' END AS token_source
FROM one, saved""")
_add("cost_metric_only", lambda t: axis.metric_only(t.metric_points, t.api_requests).groupBy("session_id").agg(F.count(F.lit(1)).alias("points")), f"{ADAPTER} SELECT session_id, CAST(count(*) AS BIGINT) AS points FROM mo GROUP BY 1")
_add("cost_token_source", lambda t: sessions.session_list(t).groupBy("token_source").agg(F.count(F.lit(1)).alias("sessions")), f"{ADAPTER} SELECT token_source, CAST(count(*) AS BIGINT) AS sessions FROM sl GROUP BY 1")
_add("price_estimate", lambda t: t.api_requests.select("id", F.round(pricing.estimated_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read"), F.col("cache_creation")), 9).alias("usd")), f"""{ADAPTER} SELECT id, round(CAST(CASE
  WHEN model LIKE '%opus%' THEN input_tokens * 15.0 + output_tokens * 75.0 + cache_read * 1.5 + cache_creation * 18.75 WHEN model LIKE '%sonnet%' THEN input_tokens * 3.0 + output_tokens * 15.0 + cache_read * 0.3 + cache_creation * 3.75
  WHEN model LIKE '%haiku%' THEN input_tokens * 1.0 + output_tokens * 5.0 + cache_read * 0.1 + cache_creation * 1.25 ELSE 0 END AS DOUBLE) / 1e6, 9) AS usd FROM api""")

_add("tools_totals", tools.totals, f"""{ADAPTER}, x AS (SELECT CAST(count(*) FILTER (WHERE decision = 'accept') AS BIGINT) AS accept, CAST(count(*) FILTER (WHERE decision = 'reject') AS BIGINT) AS reject,
  CAST(count(*) FILTER (WHERE decision = 'accept' AND source IN ('config', 'hook')) AS BIGINT) AS auto FROM td) SELECT *, round(CASE WHEN accept + reject > 0 THEN reject / (accept + reject) ELSE 0 END, 6) AS reject_rate FROM x""")
_add("tools_by_source", tools.by_source, f"{ADAPTER} SELECT source, CAST(count(*) FILTER (WHERE decision = 'accept') AS BIGINT) AS accept, CAST(count(*) FILTER (WHERE decision = 'reject') AS BIGINT) AS reject FROM td GROUP BY 1")
_add("tools_hotspots_top5", tools.hotspots, f"{ADAPTER}, x AS (SELECT tool_name, CAST(count(*) FILTER (WHERE decision = 'reject') AS BIGINT) AS reject, CAST(count(*) AS BIGINT) AS total FROM td GROUP BY 1 HAVING count(*) FILTER (WHERE decision = 'reject') > 0 ORDER BY reject DESC, tool_name LIMIT 5) SELECT *, round(reject / max(reject) OVER (), 6) AS width FROM x")
_add("last_tool_results", lambda t: tools.last_results(t, 10), f"{ADAPTER} SELECT session_id, id, ts_ms, tool_name, success, duration_ms, n AS newest FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) AS n FROM tr) WHERE n <= 10")
_add("error_log", lambda t: timeline.timeline(t).where("kind = 'api_error'").select("session_id", "ts_ms", "id", "label").unionByName(t.tool_results.where(~F.col("success")).select("session_id", "ts_ms", "id", F.col("tool_name").alias("label"))), f"{ADAPTER} SELECT session_id, ts_ms, id, model AS label FROM api WHERE is_error UNION ALL SELECT session_id, ts_ms, id, tool_name FROM tr WHERE NOT success")

_add("timeline_merged", timeline.timeline, f"{_TIMELINE} SELECT * FROM tl")
_add("timeline_indent", lambda t: timeline.with_indent(timeline.timeline(t)).select("session_id", "ts_ms", "id", "seq", "level"), f"""{_TIMELINE}, a AS (SELECT *, sum(CASE WHEN seq = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, seq, id) AS seg FROM tl),
b AS (SELECT *, CASE WHEN seq = 1 AND lag(seq) OVER (PARTITION BY session_id, seg ORDER BY ts_ms, seq, id) >= 2 THEN 1 ELSE 0 END AS turn FROM a),
c AS (SELECT *, sum(turn) OVER (PARTITION BY session_id, seg ORDER BY ts_ms, seq, id) AS runs FROM b)
SELECT session_id, ts_ms, id, seq, CAST(CASE WHEN seq = 0 THEN 0 WHEN seq >= 2 THEN least(2, runs + 1) ELSE least(2, runs) END AS BIGINT) AS level FROM c""")
_add("prompts_last_n", lambda t: timeline.newest_prompts(t, 3), f"{ADAPTER} SELECT session_id, id, ts_ms, k AS prompt_length, prompt, prompt <> '' AS stored, n AS newest FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) AS n FROM ev) WHERE n <= 3")
def _burn_sql(window: int, stale: int) -> str:
    return f"""{ADAPTER}, a AS (SELECT *, sum(cost_usd) OVER w AS c, sum(input_tokens + output_tokens) OVER w AS t, ts_ms - lag(ts_ms) OVER w AS gap FROM api WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, id)),
b AS (SELECT *, min({{'ts': ts_ms, 'id': id, 'c': c, 't': t}}) OVER (PARTITION BY session_id ORDER BY ts_ms RANGE BETWEEN {window} PRECEDING AND CURRENT ROW) AS old FROM a),
d AS (SELECT *, (ts_ms - old.ts) / 60000 AS minutes FROM b)
SELECT session_id, id, ts_ms, round(CASE WHEN minutes > 0 AND coalesce(gap, 0) <= {stale} THEN greatest(0, (c - old.c) / minutes) ELSE 0 END, 6) AS usd_per_min,
  round(CASE WHEN minutes > 0 AND coalesce(gap, 0) <= {stale} THEN greatest(0, (t - old.t) / minutes) ELSE 0 END, 6) AS tok_per_min FROM d"""


_add("burn_rate_60s", lambda t: timeline.burn_rate(t.api_requests), _burn_sql(60_000, 15_000))
_add("burn_rate_hour", lambda t: timeline.burn_rate(t.api_requests, 3_600_000, 7_200_000), _burn_sql(3_600_000, 7_200_000))

_add("daily_heatmap", daily.heatmap, f"""{_DAILY}, q AS (SELECT p[least(len(p), CAST(floor(0.25 * len(p)) AS INT) + 1)] AS q1, p[least(len(p), CAST(floor(0.5 * len(p)) AS INT) + 1)] AS q2, p[least(len(p), CAST(floor(0.75 * len(p)) AS INT) + 1)] AS q3 FROM p)
SELECT strftime(day, '%Y-%m-%d') AS day, tokens, cost_usd, CAST(CASE WHEN tokens <= 0 THEN 0 WHEN tokens <= q1 THEN 1 WHEN tokens <= q2 THEN 2 WHEN tokens <= q3 THEN 3 ELSE 4 END AS BIGINT) AS level,
  coalesce(month(day) <> lag(month(day)) OVER (ORDER BY day), TRUE) AS new_month FROM f, q""")
_add("daily_headline", daily.headline, f"{_DAILY} SELECT CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 6) AS cost_usd, CAST(count(*) FILTER (WHERE tokens > 0) AS BIGINT) AS active_days, (SELECT strftime(day, '%Y-%m-%d') FROM f ORDER BY tokens DESC, day LIMIT 1) AS busiest_day FROM f")
_add("export_session", export.export_counts, f"""{ADAPTER} SELECT s.id, coalesce(a.n, 0) AS api_requests, coalesce(d.n, 0) AS tool_decisions, coalesce(r.n, 0) AS tool_results, coalesce(e.n, 0) AS events, coalesce(a.t, 0) AS first_request FROM s
  LEFT JOIN (SELECT session_id, count(*) n, min(ts_ms) t FROM api GROUP BY 1) a ON a.session_id = s.id LEFT JOIN (SELECT session_id, count(*) n FROM td GROUP BY 1) d ON d.session_id = s.id
  LEFT JOIN (SELECT session_id, count(*) n FROM tr GROUP BY 1) r ON r.session_id = s.id LEFT JOIN (SELECT session_id, count(*) n FROM ev GROUP BY 1) e ON e.session_id = s.id""")


def keyed_requests(t: Telemetry) -> DataFrame:
    """Requests with a key by session, model and hundreds of tokens, so that some collide, in order of id."""
    return t.api_requests.withColumn("dedup_key", keys.dedup_key(F.col("session_id"), F.col("model"), F.col("k") % 10)).withColumnRenamed("id", "arrival_seq")


KEYED = f"{ADAPTER}, kd AS (SELECT *, substr(sha256(session_id || chr(0) || model || chr(0) || (k % 10)), 1, 16) AS dedup_key FROM api)"
_add("dedup_keys", lambda t: t.api_requests.select("id", keys.api_request_key(F.col("session_id"), F.lit("api_request"), keys.ms_to_ns_text(F.col("ts_ms")), F.col("model"), F.col("input_tokens"), F.col("output_tokens")).alias("dedup_key")), f"{ADAPTER} SELECT id, substr(sha256(session_id || chr(0) || 'api_request' || chr(0) || (ts_ms * 1000000) || chr(0) || model || chr(0) || input_tokens || chr(0) || output_tokens), 1, 16) AS dedup_key FROM api")
_add("series_keys", lambda t: t.metric_points.select("id", "name", "attr_key", keys.series_key(F.col("name"), F.create_map(F.lit("session.id"), F.col("session_id"), F.lit("model"), F.col("attr_key"))).alias("series_key")), f"{ADAPTER} SELECT id, name, attr_key, sha256(name || chr(0) || 'model=' || attr_key || chr(0) || 'session.id=' || session_id) AS series_key FROM mp")
_add("merge_insert_ignore", lambda t: merge.insert_ignore(keyed_requests(t), ["dedup_key"]).select("dedup_key", "arrival_seq", "model"), f"{KEYED} SELECT dedup_key, id AS arrival_seq, model FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY id) AS n FROM kd) WHERE n = 1")
_add("merge_cost_authority", lambda t: merge.cost_authority(keyed_requests(t)).select("dedup_key", "arrival_seq", "cost_source", F.round("cost_usd", 6).alias("cost_usd"), "input_tokens"), f"""{KEYED} SELECT dedup_key, min(id) AS arrival_seq, arg_min(cost_source, {{'p': CASE WHEN cost_source = 'otlp' THEN 0 ELSE 1 END, 'i': id}}) AS cost_source,
  round(arg_min(cost_usd, {{'p': CASE WHEN cost_source = 'otlp' THEN 0 ELSE 1 END, 'i': id}}), 6) AS cost_usd, arg_min(input_tokens, {{'p': CASE WHEN cost_source = 'otlp' THEN 0 ELSE 1 END, 'i': id}}) AS input_tokens FROM kd GROUP BY 1""")


def _session_rows(t: Telemetry) -> DataFrame:
    return t.events_base.select(F.col("session_id").alias("id"), F.col("ts_ms").alias("first_seen"), F.col("ts_ms").alias("last_seen"), F.col("id").alias("arrival_seq"), F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("v"), F.col("k"))).alias("app_version"), (F.col("et") == "signup").alias("has_events"))


_add("merge_sessions", lambda t: merge.merge_sessions(_session_rows(t)), f"{ADAPTER} SELECT session_id AS id, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, coalesce(arg_max('v' || k, id) FILTER (WHERE k % 5 <> 0), '') AS app_version, bool_or(et = 'signup') AS has_events FROM base GROUP BY 1")
_add("retention_survivors", lambda t: merge.retained_children(t.api_requests, merge.retained_sessions(t.sessions.join(t.sessions.agg(F.max("last_seen").alias("now"))).where("last_seen >= now - 7 * 86400000L").drop("now"), 0, 0, 50)).groupBy("session_id").agg(F.count(F.lit(1)).alias("requests")), f"""{ADAPTER}, keep AS (SELECT id FROM s WHERE last_seen >= (SELECT max(last_seen) FROM s) - 7 * 86400000 ORDER BY last_seen DESC, id DESC LIMIT 50)
SELECT session_id, CAST(count(*) AS BIGINT) AS requests FROM api WHERE session_id IN (SELECT id FROM keep) GROUP BY 1""")
_add("orphan_series", lambda t: merge.orphan_series(t.metric_points.select(F.concat_ws(":", "session_id", "attr_key").alias("series_key")).distinct(), t.metric_points.where("ts_ms % 3 = 0").select(F.concat_ws(":", "session_id", "attr_key").alias("series_key"))), f"{ADAPTER} SELECT DISTINCT session_id || ':' || attr_key AS series_key FROM mp WHERE session_id || ':' || attr_key NOT IN (SELECT session_id || ':' || attr_key FROM mp WHERE ts_ms % 3 = 0)")
_add("delta_normalize", lambda t: delta.normalize(t.raw_counter).select("series", "id", "time_ms", "value", "delta", "rule"), f"""{COUNTER} SELECT series, id, time_ms, value, CASE WHEN pv IS NULL THEN 0 WHEN start_ms <> ps OR value < pv THEN value ELSE value - pv END AS delta,
  CASE WHEN pv IS NULL THEN 'baseline' WHEN start_ms <> ps OR value < pv THEN 'reset' ELSE 'normal' END AS rule FROM lagged""")


def _calls(t: Telemetry) -> tuple[DataFrame, DataFrame]:
    """Clicks as tool uses and views as their results, by session and tool."""
    use = t.tool_decisions.select(F.col("session_id").alias("file"), F.col("tool_name").alias("tool_use_id"), F.struct("ts_ms", "id").alias("pos"), F.col("id").alias("use_id"))
    result = t.tool_results.select(F.col("session_id").alias("file"), F.col("tool_name").alias("tool_use_id"), F.struct("ts_ms", "id").alias("pos"), F.col("id").alias("result_id"))
    return use, result


_add("tool_pairing", lambda t: pairing.pair(*_calls(t)).select("result_id", "use_id"), f"""{ADAPTER}, x AS (SELECT session_id, tool_name, ts_ms, id, TRUE AS is_use FROM td UNION ALL SELECT session_id, tool_name, ts_ms, id, FALSE FROM tr),
y AS (SELECT *, lag(is_use) OVER w AS before, lag(id) OVER w AS before_id FROM x WINDOW w AS (PARTITION BY session_id, tool_name ORDER BY ts_ms, id))
SELECT id AS result_id, CASE WHEN before THEN before_id END AS use_id FROM y WHERE NOT is_use""")
_add("repo_from_path", lambda t: t.tool_results.select("id", keys.repo_of(F.concat(F.lit("/home/dev/"), "tool_name", F.when(F.col("success"), "/").otherwise(""))).alias("repo")), f"{ADAPTER} SELECT id, tool_name AS repo FROM tr")
_add("mcp_server", lambda t: t.tool_results.groupBy(keys.mcp_server(F.col("tool_name")).alias("server")).agg(F.count(F.lit(1)).alias("calls")), f"{ADAPTER} SELECT CASE WHEN tool_name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN split_part(substr(tool_name, 6), '__', 1) ELSE '' END AS server, CAST(count(*) AS BIGINT) AS calls FROM tr GROUP BY 1")
_add("redaction", lambda t: t.events.select("id", F.to_json(keys.redacted(F.from_json("attrs_json", "map<string,string>"))).alias("attrs")), f"""{ADAPTER} SELECT id, '{{"prompt_length":"' || k || '"' || CASE WHEN prompt <> '' THEN ',"prompt":"[redacted]"' ELSE '' END || '}}' AS attrs FROM ev""")
_add("value_coercion", lambda t: t.tool_results.select("id", keys.to_long(F.concat(F.col("duration_ms").cast("string"), F.when(F.col("success"), ".9").otherwise("x"))).alias("n"), keys.to_bool(F.when(F.col("success"), "True").otherwise("no")).alias("b")), f"{ADAPTER} SELECT id, CASE WHEN success THEN duration_ms ELSE 0 END AS n, success AS b FROM tr")


def _conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text"))
    return c.withColumn("n", F.row_number().over(newest)).where("n <= 2").select("conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("prompt_length"), F.col("n").cast("bigint").alias("newest"))


_entries["conversation_prompts"] = (_conversation_prompts, "SELECT conv_id, turn, CAST(strlen(coalesce(text, '')) AS BIGINT) AS prompt_length, n AS newest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS n FROM conversations WHERE role = 'user') WHERE n <= 2")


def _event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select((F.unix_micros(F.col("w.start")) / 1000).cast("bigint").alias("start_ms"), "event_type", "n", "total")


_entries["event_windows"] = (_event_windows, "SELECT epoch_us(ts) // 3600000000 * 3600000 AS start_ms, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")

_SINCE, _ONE = 1_704_500_000_000, "u12"
_add("sessions_since", lambda t: sessions.session_list(t, since=_SINCE).select("id", "last_seen", "cost_usd"), f"{ADAPTER} SELECT id, last_seen, cost_usd FROM sl WHERE last_seen >= {_SINCE}")
_add("cost_series_since", lambda t: cost.cost_series(t, "day", since=_SINCE), _series_sql(_DAY, f"ts_ms >= {_SINCE}", f"ts_ms >= {_SINCE}") + _SERIES_OUT)
_add("cost_series_session", lambda t: cost.cost_series(t, "hour", session=_ONE), _series_sql(_HOUR, f"session_id = '{_ONE}'", f"session_id = '{_ONE}'") + _SERIES_OUT)
_add("tools_by_source_session", lambda t: tools.by_source(t, _SINCE, _ONE), f"{ADAPTER} SELECT source, CAST(count(*) FILTER (WHERE decision = 'accept') AS BIGINT) AS accept, CAST(count(*) FILTER (WHERE decision = 'reject') AS BIGINT) AS reject FROM td WHERE ts_ms >= {_SINCE} AND session_id = '{_ONE}' GROUP BY 1")


def transcript_lines(t: Telemetry) -> DataFrame:
    """The driver's requests and results as transcript lines (file, pos, value)."""
    time = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    requests = t.api_requests.where("not is_error")
    usage = F.struct("input_tokens", "output_tokens", F.col("cache_creation").alias("cache_creation_input_tokens"), F.col("cache_read").alias("cache_read_input_tokens"))
    call = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), "id").alias("id"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("run "), "k").alias("command")).alias("input"))
    message = F.struct(F.lit("assistant").alias("role"), "model", usage.alias("usage"), F.array(call).alias("content"))
    head = lambda kind, n: (F.lit(kind).alias("type"), F.concat(F.lit(kind), "id").alias("uuid"), time(F.col("ts_ms") + n).alias("timestamp"), F.col("session_id").alias("sessionId"))
    uses = requests.select("session_id", (F.col("id") * 3).alias("pos"), F.to_json(F.struct(*head("assistant", 0), message.alias("message"))).alias("value"))
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), "id").alias("tool_use_id"), (F.col("k") % 4 == 0).alias("is_error"))
    replies = requests.where("k % 2 = 0").select("session_id", (F.col("id") * 3 + 1).alias("pos"), F.to_json(F.struct(*head("user", 1), F.struct(F.lit("user").alias("role"), F.array(result).alias("content")).alias("message"))).alias("value"))
    prompts = requests.where("k % 5 = 0").select("session_id", (F.col("id") * 3 + 2).alias("pos"), F.to_json(F.struct(*head("user", 2), F.struct(F.lit("user").alias("role"), F.concat(F.lit("[draft] say "), "k").alias("content")).alias("message"))).alias("value"))
    return uses.unionByName(replies).unionByName(prompts).withColumnRenamed("session_id", "file")


def request_logs(t: Telemetry) -> DataFrame:
    """A part of the requests as log exports."""
    requests = t.api_requests.where("not is_error and k % 3 = 0")
    said = lambda name, value: F.struct(F.lit(name).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))
    attributes = F.array(said("session.id", F.col("session_id")), said("model", F.col("model")), said("input_tokens", F.col("input_tokens")), said("output_tokens", F.col("output_tokens")), said("cost", F.col("cost_usd")), said("duration", F.col("duration_ms")), said("app.version", F.lit("9")))
    record = F.struct((F.col("ts_ms") * 1_000_000).cast("string").alias("timeUnixNano"), F.lit("claude_code.api_request").alias("eventName"), attributes.alias("attributes"))
    document = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    return requests.select(F.from_json(document, otlp.LOGS).alias("d")).select("d.*")


def _collected(t: Telemetry) -> collect.Collected:
    """The driver's rows taken in again from transcript lines and exports."""
    return collect.collect(transcript_lines(t), logs=request_logs(t))


def _written_lines(t: Telemetry, files: int = 16) -> str:
    """A new folder with the transcript lines in so many *.jsonl files, a session's lines in one of them and in order."""
    spark = t.events_base.sparkSession
    folder = shared.new_folder(spark, "lines")
    transcript_lines(t).repartition(files, "file").sortWithinPartitions("file", "pos").select("value").write.text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files_there = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files_there.listStatus(path):
        if status.getPath().getName().endswith(".txt"):
            files_there.rename(status.getPath(), status.getPath().suffix(".jsonl"))
    return folder


def _followed_tools(t: Telemetry) -> DataFrame:
    """transcript_tools from a stream of growing files: several starts on one checkpoint, each with a part of the bytes, so that calls stay open between them."""
    spark = t.events_base.sparkSession
    folder, out = _written_lines(t), shared.new_folder(spark, "followed")
    checkpoint = f"{out}-progress"
    total = sum(append_jsonl.sizes(folder).values())
    for _ in range(STARTS):
        lines = append_jsonl.follow(spark, folder, checkpoint, -(-total // STARTS)).withColumnRenamed("offset", "pos")
        results = pair_stream.tool_results(transcript.decode(lines))
        runs.run_available(spark, results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
    return spark.read.parquet(out)


_TAKEN = f"""{ADAPTER}, rq AS (SELECT *, k % 3 = 0 AS exported FROM api WHERE NOT is_error),
one AS (
  SELECT session_id, ts_ms, model, input_tokens, output_tokens, bool_or(exported) AS exported, arg_min(cost_usd, CASE WHEN exported THEN id END) AS told,
    any_value(CASE WHEN model LIKE '%opus%' THEN input_tokens * 15.0 + output_tokens * 75.0 + cache_read * 1.5 + cache_creation * 18.75 WHEN model LIKE '%sonnet%' THEN input_tokens * 3.0 + output_tokens * 15.0 + cache_read * 0.3 + cache_creation * 3.75
      WHEN model LIKE '%haiku%' THEN input_tokens * 1.0 + output_tokens * 5.0 + cache_read * 0.1 + cache_creation * 1.25 ELSE 0 END / 1e6) AS estimate
  FROM rq GROUP BY 1, 2, 3, 4, 5)"""
_add("cross_source_dedup", lambda t: _collected(t).api_requests.groupBy("session_id", "model", "cost_source").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("cost_usd"), 9).alias("cost_usd")), f"""{_TAKEN}
SELECT session_id, model, CASE WHEN exported THEN 'otlp' ELSE 'jsonl-estimate' END AS cost_source, CAST(count(*) AS BIGINT) AS requests, round(sum(CAST(CASE WHEN exported THEN told ELSE estimate END AS DOUBLE)), 9) AS cost_usd FROM one GROUP BY 1, 2, 3""")
_TOOLS_SQL = f"""{ADAPTER} SELECT session_id, 'Bash' AS tool_name, k % 4 <> 0 AS success, CAST(count(*) AS BIGINT) AS results, CAST(count(DISTINCT k) AS BIGINT) AS commands FROM api WHERE NOT is_error AND k % 2 = 0 GROUP BY 1, 2, 3"""
_tools_by_session = lambda results: results.groupBy("session_id", "tool_name", "success").agg(F.count(F.lit(1)).alias("results"), F.countDistinct("bash_command").alias("commands"))
_add("transcript_tools", lambda t: _tools_by_session(_collected(t).tool_results), _TOOLS_SQL)
_add("stream_transcript_tools", lambda t: _tools_by_session(_followed_tools(t)), _TOOLS_SQL)
_add("transcript_prompts", lambda t: timeline.prompt_fields(_collected(t).events).select("session_id", "ts_ms", "prompt_length", "prompt"), f"{ADAPTER} SELECT session_id, ts_ms + 2 AS ts_ms, CAST(strlen('[draft] say ' || k) AS BIGINT) AS prompt_length, '[draft] say ' || k AS prompt FROM api WHERE NOT is_error AND k % 5 = 0")
_add("collected_sessions", lambda t: _collected(t).sessions.select("id", "first_seen", "last_seen", "app_version", F.coalesce("has_events", F.lit(False)).alias("has_events")), f"""{ADAPTER}
SELECT session_id AS id, min(ts_ms) AS first_seen, max(ts_ms + CASE WHEN k % 5 = 0 THEN 2 WHEN k % 2 = 0 THEN 1 ELSE 0 END) AS last_seen, CASE WHEN bool_or(k % 3 = 0) THEN '9' ELSE '' END AS app_version, bool_or(k % 3 = 0) AS has_events FROM api WHERE NOT is_error GROUP BY 1""")
_add("collected_cost_by_model", lambda t: cost.cost_by_model(_collected(t)).select("model", F.round("cost_usd", 3).alias("cost_usd"), "tokens"), f"""{_TAKEN}
SELECT model, round(sum(CAST(CASE WHEN exported THEN told ELSE estimate END AS DOUBLE)), 3) AS cost_usd, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM one GROUP BY 1""")

QUERIES: dict[str, Query] = {name: query for name, (query, _) in _entries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _entries.items() if sql}
