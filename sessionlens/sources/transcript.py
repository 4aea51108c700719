"""Agent transcripts (JSON lines) to telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, pricing
from ..operators import pairing
from . import append_jsonl

_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"
#: content is a string or an array, so it is read as text and looked at later.
RECORD = f"type string, uuid string, timestamp string, sessionId string, cwd string, gitBranch string, version string, requestId string, message struct<role:string,model:string,id:string,usage:{_USAGE},content:string>"
BLOCK = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean>>"
COST_SOURCE = "jsonl-estimate"


#: What a line can hold; each becomes a row of its own.
KINDS = ("malformed", "session", "request", "use", "result", "prompt")


def read_lines(spark: SparkSession, folder: str, range_bytes: int = append_jsonl.RANGE) -> DataFrame:
    """file, pos, value of each line of the *.jsonl files below a folder, whatever the case of the ending. pos is the line's byte offset; a task reads `range_bytes` at most."""
    return append_jsonl.read(spark, folder, range_bytes).withColumnRenamed("offset", "pos").where("trim(value) <> ''")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def decode(lines: DataFrame) -> DataFrame:
    """What each line holds, one row for each thing of KINDS, from one parse of the line: kind, file, pos, index (of the content's block), session_id, ts_ms and what the kind needs."""
    document = F.try_parse_json("value")
    parsed = F.when(document.isNotNull(), F.from_json("value", RECORD))
    # a prompt may look like an array; what it is, only the JSON type tells
    content_kind = F.schema_of_variant(F.try_variant_get(document, "$.message.content", "variant"))
    rows = lines.select("file", "pos", parsed.alias("r"), F.coalesce(content_kind.startswith("ARRAY"), F.lit(False)).alias("listed"))
    content, usage = F.col("r.message.content"), F.col("r.message.usage")
    rows = rows.withColumn("blocks", F.when(F.col("listed"), F.from_json(content, BLOCK)))

    none = F.lit(None)

    def item(kind: str, index=none, tool_use_id=none, tool_name=none, text=none, success=none, extra=none) -> Column:
        values = (F.lit(kind), index.cast("int"), tool_use_id.cast("string"), tool_name.cast("string"), text.cast("string"), success.cast("boolean"), extra.cast("string"))
        return F.struct(*(v.alias(n) for v, n in zip(values, ("kind", "index", "tool_use_id", "tool_name", "text", "success", "extra"), strict=True)))

    def block(x: Column, i: Column) -> Column:
        uuid = F.concat_ws(":", _text("r.uuid"), i.cast("string"))
        by_user = F.col("r.type") == "user"
        use = item("use", i, x["id"], x["name"], F.get_json_object(x["input"], "$.command"))
        result = item("result", i, x["tool_use_id"], success=~F.coalesce(x["is_error"], F.lit(False)))
        prompt = item("prompt", i, text=x["text"], extra=uuid)
        return F.when((F.col("r.type") == "assistant") & (x["type"] == "tool_use"), use).when(by_user & (x["type"] == "tool_result"), result).when(by_user & (x["type"] == "text") & (F.trim(x["text"]) != ""), prompt)

    plain = (F.col("r.type") == "user") & ~F.col("listed") & (F.trim(content) != "")
    whole = F.array(F.when(F.col("r").isNull(), item("malformed")), F.when(F.col("r").isNotNull(), item("session")), F.when((F.col("r.type") == "assistant") & usage.isNotNull(), item("request")), F.when(plain, item("prompt", text=content, extra=_text("r.uuid"))))
    items = F.array_compact(F.concat(whole, F.coalesce(F.transform("blocks", block), F.array().cast("array<struct<kind:string,index:int,tool_use_id:string,tool_name:string,text:string,success:boolean,extra:string>>"))))
    number = lambda c: F.coalesce(usage[c], F.lit(0))
    return rows.select(
        "file", "pos", _text("r.sessionId").alias("session_id"), keys.parse_time_ms(F.col("r.timestamp")).alias("ts_ms"), _text("r.message.model").alias("model"), _text("r.version").alias("app_version"), _text("r.gitBranch").alias("git_branch"), F.col("r.cwd").alias("cwd"),
        number("input_tokens").alias("input_tokens"), number("output_tokens").alias("output_tokens"), number("cache_read_input_tokens").alias("cache_read"), number("cache_creation_input_tokens").alias("cache_creation"), F.inline(items),
    )


def stats(decoded: DataFrame) -> DataFrame:
    """Lines, decoded and malformed lines: one row."""
    lines = F.col("kind").isin("malformed", "session")
    return decoded.agg(F.count_if(lines).alias("lines"), F.count_if(F.col("kind") == "session").alias("decoded"), F.count_if(F.col("kind") == "malformed").alias("malformed"))


def api_requests(decoded: DataFrame) -> DataFrame:
    """Assistant records with usage, at estimated cost."""
    rows = decoded.where("kind = 'request'").select("session_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_read", "cache_creation", "file", "pos")
    cost = pricing.estimated_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read"), F.col("cache_creation"))
    key = keys.api_request_key(F.col("session_id"), F.lit("api_request"), keys.ms_to_ns_text(F.col("ts_ms")), F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return rows.withColumn("cost_usd", cost).withColumn("cost_source", F.lit(COST_SOURCE)).withColumn("is_error", F.lit(False)).withColumn("dedup_key", key)


def tool_uses(decoded: DataFrame) -> DataFrame:
    return decoded.where("kind = 'use'").select("file", "tool_use_id", F.struct("pos", "index").alias("pos"), "tool_name", F.col("text").alias("command"), F.col("ts_ms").alias("use_ms"))


def tool_answers(decoded: DataFrame) -> DataFrame:
    return decoded.where("kind = 'result'").select("file", "tool_use_id", F.struct("pos", "index").alias("pos"), "session_id", "ts_ms", "success")


def tool_results(decoded: DataFrame, store_text: bool = True) -> DataFrame:
    """Results, each paired with the latest unconsumed tool use of its id before it in the file; unmatched ones have an empty tool name, those without a time take the use's."""
    return finished(pairing.pair(tool_uses(decoded), tool_answers(decoded)), store_text)


def finished(paired: DataFrame, store_text: bool = True) -> DataFrame:
    """Rows of tool_results() from results with the columns of their use (tool_name, command, use_ms), null where none was found."""
    paired = paired.withColumn("tool_name", _text("tool_name"))
    paired = paired.withColumn("ts_ms", F.when(F.col("ts_ms") == 0, F.coalesce("use_ms", F.lit(0))).otherwise(F.col("ts_ms")))
    command = _text("command") if store_text else F.when(_text("command") != "", F.lit(keys.MASK)).otherwise("")
    bash = F.when(F.col("tool_name") == "Bash", command).otherwise("")
    key = keys.tool_result_key(F.col("session_id"), keys.ms_to_ns_text(F.col("ts_ms")), F.col("tool_name"), F.col("tool_use_id"))
    return paired.select("session_id", "ts_ms", "tool_name", "success", bash.alias("bash_command"), keys.mcp_server(F.col("tool_name")).alias("mcp_server"), "tool_use_id", key.alias("dedup_key"))


def user_prompts(decoded: DataFrame, store_text: bool = True) -> DataFrame:
    """Prompts: a string content, or each text block that isn't blank. Lengths are in bytes."""
    rows = decoded.where("kind = 'prompt'")
    length = F.octet_length("text").cast("bigint")
    attrs = F.to_json(F.struct(length.alias("prompt_length"), F.col("text").alias("prompt"))) if store_text else F.to_json(F.struct(length.alias("prompt_length")))
    key = keys.event_key(F.col("session_id"), F.lit("user_prompt"), keys.ms_to_ns_text(F.col("ts_ms")), F.col("extra"))
    return rows.select("session_id", "ts_ms", F.lit("user_prompt").alias("name"), attrs.alias("attrs_json"), key.alias("dedup_key"))


def sessions(decoded: DataFrame) -> DataFrame:
    """One row a session id: earliest and latest known time, models in order of appearance, last version, branch and repo."""
    rows = decoded.where("kind = 'session'").withColumn("id", F.col("session_id")).withColumn("at", F.struct("file", "pos"))
    known = F.when(F.col("ts_ms") > 0, F.col("ts_ms"))
    last = lambda c: F.coalesce(F.max_by(c, F.when(c != "", F.col("at"))), F.lit(""))
    merged = rows.groupBy("id").agg(
        F.coalesce(F.min(known), F.lit(0)).alias("first_seen"), F.coalesce(F.max(known), F.lit(0)).alias("last_seen"),
        last(F.col("app_version")).alias("app_version"), last(F.col("git_branch")).alias("git_branch"), last(keys.repo_of(F.col("cwd"))).alias("repo"),
    )
    first = rows.where("model <> ''").groupBy("id", "model").agg(F.min("at").alias("at"))
    models = first.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]), ",").alias("model_set"))
    return merged.join(models, "id", "left").withColumn("model_set", _text("model_set"))
