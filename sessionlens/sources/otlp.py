"""OTLP/JSON exports (metrics, logs, traces) to telemetry tables, one export document a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys

#: Lists and maps are read as JSON text and looked into when they are stored.
_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,arrayValue:string,kvlistValue:string,bytesValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_POINT = f"struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,asDouble:double,asInt:string>"
METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRS}>,scopeMetrics:array<struct<metrics:array<struct<name:string,sum:struct<aggregationTemporality:int,isMonotonic:boolean,dataPoints:array<{_POINT}>>,gauge:struct<dataPoints:array<{_POINT}>>,histogram:struct<dataPoints:array<struct<count:string>>>>>>>>>"
LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,eventName:string,body:{_VALUE},attributes:{_ATTRS}>>>>>>"
TRACES = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>,attributes:{_ATTRS}>>>>>>"
#: Dimensions that tell series apart.
DIMENSIONS = ("type", "model", "language", "session.id")
#: Bounds of stored attributes.
MOST_KEYS, MOST_BYTES, MOST_DEPTH = 256, 65536, 8
TRUNCATED = "__truncated__"


def _as_map(attributes: Column) -> Column:
    """Attribute list to a string map; the last of equal keys wins, empty keys go."""
    text = lambda v: F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"), v["arrayValue"], v["kvlistValue"], v["bytesValue"])
    filled = F.filter(F.coalesce(attributes, F.array()), lambda a: F.coalesce(a["key"], F.lit("")) != "")
    names = F.array_distinct(F.transform(filled, lambda a: a["key"]))
    last = lambda k: F.element_at(F.filter(filled, lambda a: a["key"] == k), -1)
    return F.map_from_arrays(names, F.transform(names, lambda k: text(last(k)["value"])))


def _quoted(text: Column) -> Column:
    """A text that isn't null as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"^\[(.*)\]$", 1)


def _keyed(entries: Column) -> Column:
    """Key-value pairs in order of key; the last of equal keys wins, empty keys go."""
    filled = F.filter(entries, lambda e: F.coalesce(e["key"], F.lit("")) != "")
    names = F.array_sort(F.array_distinct(F.transform(filled, lambda e: e["key"])))
    return F.transform(names, lambda k: F.element_at(F.filter(filled, lambda e: e["key"] == k), -1))


def nested_json(value: Column, depth: int = 0) -> Column:
    """A value of the wire form (a variant) as plain JSON text; null for null and unknown values. Lists and maps from MOST_DEPTH on become a marker."""
    get = lambda name, kind="variant": F.try_variant_get(value, f"$.{name}", kind)
    scalar = F.coalesce(F.to_json(get("stringValue")), F.to_json(get("boolValue")), get("intValue", "bigint").cast("string"), F.to_json(get("doubleValue")))
    is_list, is_map, is_bytes = get("arrayValue").isNotNull(), get("kvlistValue").isNotNull(), get("bytesValue").isNotNull()
    scalar = F.when(is_bytes, _quoted(F.try_to_binary(get("bytesValue", "string"), F.lit("base64")).cast("string"))).otherwise(scalar)
    if depth >= MOST_DEPTH:
        return F.when(is_list | is_map, F.lit(f'"{TRUNCATED}:depth_exceeded"')).otherwise(scalar)
    entry = "array<struct<key:string,value:variant>>"
    listed = F.transform(F.coalesce(get("arrayValue.values", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    items = F.when(is_list, listed).otherwise(_keyed(F.coalesce(get("kvlistValue.values", entry), F.array().cast(entry))))
    name = lambda i: F.when(i["key"].isNotNull(), F.concat(_quoted(i["key"]), F.lit(":"))).otherwise("")
    parts = F.transform(items, lambda i: F.concat(name(i), F.coalesce(nested_json(i["value"], depth + 1), F.lit("null"))))
    # the inner levels stand here once, or the expression would double with each
    ends = [F.when(is_list, F.lit(a)).otherwise(b) for a, b in ("[{", "]}")]
    return F.when(is_list | is_map, F.concat(ends[0], F.array_join(parts, ","), ends[1])).otherwise(scalar)


def _as_json(attributes: Column) -> Column:
    """Attribute list to a map of names to JSON texts: the first MOST_KEYS that have a name, of equal names the last. With more, a marker."""
    filled = F.filter(F.coalesce(attributes, F.array()), lambda a: F.coalesce(a["key"], F.lit("")) != "")

    def text(v: Column) -> Column:
        number = F.coalesce(v["intValue"].try_cast("bigint").cast("string"), F.when(v["doubleValue"].isNotNull(), F.regexp_extract(F.to_json(F.array(v["doubleValue"])), r"^\[(.*)\]$", 1)))
        scalar = F.coalesce(F.when(v["stringValue"].isNotNull(), _quoted(v["stringValue"])), v["boolValue"].cast("string"), number)
        rest = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), v[name]) for name in ("arrayValue", "kvlistValue")), F.concat(F.lit('"bytesValue":"'), v["bytesValue"], F.lit('"'))), F.lit("}"))
        return F.coalesce(scalar, nested_json(F.try_parse_json(rest)), F.lit("null"))

    kept = _keyed(F.slice(filled, 1, MOST_KEYS))
    known = F.map_from_arrays(F.transform(kept, lambda a: a["key"]), F.transform(kept, lambda a: text(a["value"])))
    marker = F.create_map(F.lit(TRUNCATED), F.lit('"attribute_count_exceeded"'))
    return F.when(F.size(filled) > MOST_KEYS, F.map_concat(F.map_filter(known, lambda k, v: k != TRUNCATED), marker)).otherwise(known)


def _session(own: str, resource: str) -> Column:
    return keys.first_text(*(F.try_element_at(F.col(m), F.lit(k)) for m in (own, resource) for k in ("session.id", "session_id")))


def _get(name: str, *more: str) -> Column:
    return F.coalesce(*(F.try_element_at(F.col("attrs"), F.lit(k)) for k in (name, *more)), F.lit(""))


def _about() -> Column:
    """What a record says of its session, its own attributes first."""
    text = lambda *names: keys.first_text(*(F.try_element_at(F.col(m), F.lit(k)) for m in ("attrs", "res") for k in names))
    return F.struct(text("app.version", "service.version").alias("app_version"), text("user.email").alias("user_email"), text("organization.id", "org.id", "org_id").alias("org_id"), text("model").alias("model"))


def _stored(store_prompts: bool) -> Column:
    """attrs_json of a row with `values`; without prompts the values of sensitive names are masked."""
    return bounded_json(F.col("values") if store_prompts else keys.redacted(F.col("values"), f'"{keys.MASK}"'))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def metric_rows(exports: DataFrame) -> DataFrame:
    """Every point with its kind, 'accepted' or 'rejected', and why it was rejected. A metric of a shape without such points is one rejected row."""
    m = exports.select(F.explode("resourceMetrics").alias("rm")).select("rm.resource", F.explode("rm.scopeMetrics").alias("sm")).select("resource", F.explode("sm.metrics").alias("m"))
    is_sum, known = F.col("m.sum").isNotNull(), F.col("m.sum").isNotNull() | F.col("m.gauge").isNotNull()
    none = F.array(F.lit(None).cast(_POINT))
    points = m.select("resource", "m", F.explode(F.when(known, F.coalesce("m.sum.dataPoints", "m.gauge.dataPoints")).otherwise(none)).alias("p"))
    value = F.coalesce(F.col("p.asDouble"), F.col("p.asInt").try_cast("double"))
    rows = points.select(
        F.col("m.name").alias("name"), F.when(is_sum, 0).otherwise(1).alias("value_kind"), F.when(is_sum, F.coalesce("m.sum.aggregationTemporality", F.lit(0))).otherwise(0).alias("temporality"),
        value.alias("value"), F.coalesce(F.col("p.startTimeUnixNano").try_cast("bigint"), F.lit(0)).alias("start_ns"), F.coalesce(F.col("p.timeUnixNano").try_cast("bigint"), F.lit(0)).alias("time_ns"),
        _as_map(F.col("p.attributes")).alias("attrs"), _as_map(F.col("resource.attributes")).alias("res"), known.alias("known"), _as_json(F.col("p.attributes")).alias("values"),
    )
    rows = rows.withColumn("session_id", _session("attrs", "res"))
    dims = F.map_filter(F.map_concat(F.col("attrs"), F.when(F.map_contains_key("attrs", "session.id"), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("session.id"), F.col("session_id")))), lambda k, v: k.isin(*DIMENSIONS) & (F.coalesce(v, F.lit("")) != ""))
    rows = rows.withColumn("series_key", keys.series_key(F.col("name"), dims)).withColumn("ts_ms", keys.ns_to_ms(F.col("time_ns"))).withColumn("attr_key", keys.first_text(*(F.try_element_at(F.col("attrs"), F.lit(k)) for k in ("type", "model", "language"))))
    bad = F.when(~F.col("known"), "unsupported shape").when(F.col("value").isNull(), "no value").when(F.isnan("value") | (F.abs("value") == F.lit(float("inf"))), "not finite")
    rows = rows.withColumn("reason", bad).withColumn("about", _about()).withColumn("attrs_json", _stored(True))
    return rows.withColumn("kind", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")).drop("res", "known", "values")


def metric_points(exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted points, and rejected ones with a reason."""
    rows = metric_rows(exports)
    return rows.where("kind = 'accepted'").drop("reason", "kind"), rows.where("kind = 'rejected'").select("name", "reason")


def log_records(exports: DataFrame) -> DataFrame:
    """session_id, ts_ms, raw_ns, name, attrs (texts), values (JSON texts), body, about, kind of each record; ts_ms is the event time, else the observed one, raw_ns the event time as it came; kind is the table that it goes to."""
    r = exports.select(F.explode("resourceLogs").alias("rl")).select("rl.resource", F.explode("rl.scopeLogs").alias("sl")).select("resource", F.explode("sl.logRecords").alias("r"))
    r = r.select("r", _as_map(F.col("r.attributes")).alias("attrs"), _as_json(F.col("r.attributes")).alias("values"), _as_map(F.col("resource.attributes")).alias("res"))
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    ns = F.when(number("r.timeUnixNano") > 0, number("r.timeUnixNano")).otherwise(number("r.observedTimeUnixNano"))
    rows = r.select(_session("attrs", "res").alias("session_id"), keys.ns_to_ms(ns).alias("ts_ms"), number("r.timeUnixNano").alias("raw_ns"), keys.event_name(F.col("r.eventName"), F.try_element_at(F.col("attrs"), F.lit("event.name"))).alias("name"), "attrs", "values", F.coalesce("r.body.stringValue", F.lit("")).alias("body"), _about().alias("about"))
    kind = F.when(F.col("name").isin("api_request", "api_error"), "request").when(F.col("name").isin("tool_decision", "tool_result"), F.substring_index("name", "_", -1)).otherwise("event")
    return rows.withColumn("kind", kind)


def api_requests(records: DataFrame, store_prompts: bool = True) -> DataFrame:
    rows = records.where("kind = 'request'")
    number = lambda name, *more: keys.to_long(_get(name, *more))
    rows = rows.select(
        "session_id", "ts_ms", "name", _get("model").alias("model"), number("input_tokens").alias("input_tokens"), number("output_tokens").alias("output_tokens"), number("cache_read_tokens", "cache_read").alias("cache_read"), number("cache_creation_tokens", "cache_creation").alias("cache_creation"),
        keys.to_double(_get("cost_usd", "cost")).alias("cost_usd"), number("duration_ms", "duration").alias("duration_ms"), (F.col("name") == "api_error").alias("is_error"), number("status_code", "http.status_code").alias("status_code"), _stored(store_prompts).alias("attrs_json"),
    )
    key = keys.api_request_key(F.col("session_id"), F.col("name"), keys.ms_to_ns_text(F.col("ts_ms")), F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return rows.withColumn("cost_source", F.lit("otlp")).withColumn("dedup_key", key).drop("name")


def tool_decisions(records: DataFrame, store_prompts: bool = True) -> DataFrame:
    rows = records.where("kind = 'decision'").select("session_id", "ts_ms", _get("tool_name", "tool").alias("tool_name"), _get("decision").alias("decision"), _get("source").alias("source"), _stored(store_prompts).alias("attrs_json"))
    return rows.withColumn("dedup_key", keys.tool_decision_key(F.col("session_id"), keys.ms_to_ns_text(F.col("ts_ms")), F.col("tool_name"), F.col("decision"), F.col("source")))


def tool_results(records: DataFrame, store_prompts: bool = True) -> DataFrame:
    nested = lambda *names: keys.first_text(*(F.get_json_object(_get("tool_parameters"), f"$.{n}") for n in names))
    bash = keys.first_text(nested("bash_command", "command"), nested("full_command"))
    rows = records.where("kind = 'result'").select(
        "session_id", "ts_ms", _get("tool_name", "tool").alias("tool_name"), keys.to_bool(_get("success")).alias("success"), keys.to_long(_get("duration_ms", "duration")).alias("duration_ms"),
        (bash if store_prompts else F.when(bash != "", F.lit(keys.MASK)).otherwise("")).alias("bash_command"), nested("mcp_server", "server_name", "server").alias("mcp_server"), _stored(store_prompts).alias("attrs_json"),
    )
    return rows.withColumn("dedup_key", keys.tool_result_key(F.col("session_id"), keys.ms_to_ns_text(F.col("ts_ms")), F.col("tool_name")))


def generic_events(records: DataFrame, store_prompts: bool = True) -> DataFrame:
    rows = records.where("kind = 'event'")
    return rows.select("session_id", "ts_ms", "name", _stored(store_prompts).alias("attrs_json"), keys.event_key(F.col("session_id"), F.col("name"), F.col("raw_ns"), F.col("body")).alias("dedup_key"))


def bounded_json(values: Column) -> Column:
    """A map of names to JSON texts as one JSON object in order of name; over MOST_BYTES, the names that fit one after another, and a marker."""
    entries = F.array_sort(F.map_entries(values))
    written = F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    whole = F.concat(F.lit("{"), F.array_join(written, ","), F.lit("}"))
    marker = f'"{TRUNCATED}":"byte_size_exceeded"'
    start = F.struct(F.lit(len(marker) + 2).alias("size"), F.lit(False).alias("full"), F.lit(marker).alias("text"))
    own = F.filter(written, lambda e: ~e.startswith(f'"{TRUNCATED}":'))
    grow = lambda a, e: F.struct((a["size"] + F.octet_length(e) + 1).alias("size"), F.lit(False).alias("full"), F.concat(a["text"], F.lit(","), e).alias("text"))
    stop = lambda a: F.struct(a["size"].alias("size"), F.lit(True).alias("full"), a["text"].alias("text"))
    cut = F.aggregate(own, start, lambda a, e: F.when(a["full"] | (a["size"] + F.octet_length(e) + 1 > MOST_BYTES), stop(a)).otherwise(grow(a, e)))
    return F.when(F.octet_length(whole) > MOST_BYTES, F.concat(F.lit("{"), cut["text"], F.lit("}"))).otherwise(whole)


def sessions(points: DataFrame, records: DataFrame) -> DataFrame:
    """One row a session id of accepted points and log records: earliest and latest known time, the first known texts, models in order of time, where its tokens come from, and whether it has log records."""
    cost_or_tokens = F.col("name").isin("cost.usage", "claude_code.cost.usage", "token.usage", "claude_code.token.usage")
    source = F.when(F.col("name").isin("api_request", "api_error"), F.lit(2))
    rows = points.select("session_id", "ts_ms", "about", F.when(cost_or_tokens, F.lit(1)).alias("source"), F.lit(False).alias("logged"))
    rows = rows.unionByName(records.select("session_id", "ts_ms", "about", source.alias("source"), F.lit(True).alias("logged"))).where("session_id <> ''")
    known = F.when(F.col("ts_ms") > 0, F.col("ts_ms"))
    first = lambda c: F.coalesce(F.min_by(f"about.{c}", F.when(F.col(f"about.{c}") != "", F.col("ts_ms"))), F.lit("")).alias(c)
    merged = rows.groupBy(F.col("session_id").alias("id")).agg(
        F.coalesce(F.min(known), F.lit(0)).alias("first_seen"), F.coalesce(F.max(known), F.lit(0)).alias("last_seen"), first("app_version"), first("user_email"), first("org_id"),
        F.when(F.max("source") == 2, "events").when(F.max("source") == 1, "metrics").otherwise("").alias("token_source"), F.max("logged").alias("has_events"),
    )
    models = rows.where("about.model <> ''").groupBy(F.col("session_id").alias("id"), F.col("about.model").alias("model")).agg(F.min("ts_ms").alias("at"))
    models = models.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]), ",").alias("model_set"))
    return merged.join(models, "id", "left").withColumn("model_set", F.coalesce("model_set", F.lit("")))


def spans(exports: DataFrame, store_prompts: bool = True) -> DataFrame:
    s = exports.select(F.explode("resourceSpans").alias("rs")).select("rs.resource", F.explode("rs.scopeSpans").alias("ss")).select("resource", F.explode("ss.spans").alias("s"))
    s = s.select("s", _as_map(F.col("s.attributes")).alias("attrs"), _as_json(F.col("s.attributes")).alias("values"), _as_map(F.col("resource.attributes")).alias("res"))
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    time = lambda c: keys.ns_to_ms(F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)))
    rows = s.select(_session("attrs", "res").alias("session_id"), text("s.traceId").alias("trace_id"), text("s.spanId").alias("span_id"), text("s.parentSpanId").alias("parent_span_id"), F.col("s.name").alias("name"), time("s.startTimeUnixNano").alias("start_ts"), time("s.endTimeUnixNano").alias("end_ts"), keys.status_text(F.coalesce("s.status.code", F.lit(0))).alias("status"), _stored(store_prompts).alias("attrs_json"))
    return rows.where("trace_id <> '' or span_id <> ''")
