"""The driver's `events` table as the telemetry tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ("claude-opus-4", "claude-sonnet-4", "claude-haiku-4", "other-model")
TOOLS = ("Bash", "Edit", "Read", "Write", "Grep", "WebFetch", "mcp__srv__run")
SOURCES = ("config", "hook", "user_temporary", "user_permanent")


def _pick(names: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, names)), (F.col("k") % len(names) + 1).cast("int"))


@dataclass
class Telemetry:
    """Lazy tables; each scans only the event types it needs."""

    events_base: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Telemetry:
        e = spark.read.parquet(f"{sf_dir}/events.parquet")
        # whole-number division: a double would do for now, but not for every microsecond
        ts = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
        e = e.select(F.col("event_id").alias("id"), ts.alias("ts_ms"), F.col("user_id").alias("u"), F.col("event_type").alias("et"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
        e = e.withColumn("session_id", F.concat(F.lit("u"), F.col("u"))).withColumn("cost_ok", F.col("u") % 10 != 9)
        e = e.withColumn("event_axis", F.col("cost_ok") & (F.col("u") % 4 != 3)).withColumn("metric_axis", F.col("cost_ok") & (F.col("u") % 4).isin(2, 3))
        return cls(e)

    @property
    def api_requests(self) -> DataFrame:
        e = self.events_base.where("event_axis and et in ('purchase', 'error')")
        error = F.col("et") == "error"
        of = lambda c: F.when(error, F.lit(0)).otherwise(c).cast("bigint")
        k = F.col("k")
        return e.select(
            "id", "session_id", "ts_ms", _pick(MODELS).alias("model"), of(k * 10).alias("input_tokens"), of(k * 3).alias("output_tokens"), of(k % 5 * 200).alias("cache_read"), of(k % 7 * 50).alias("cache_creation"),
            F.when(error, F.lit(0.0)).otherwise(F.col("value") / 1000).alias("cost_usd"), of(k * 20).alias("duration_ms"), error.alias("is_error"), F.when(error, F.lit(529)).otherwise(F.lit(0)).cast("bigint").alias("status_code"),
            F.when(k % 3 == 0, "otlp").otherwise("jsonl-estimate").alias("cost_source"), "k",
        )

    @property
    def metric_points(self) -> DataFrame:
        e = self.events_base.where("metric_axis and et = 'purchase'")
        k = F.col("k")
        point = lambda name, key, value: F.struct(F.lit(name).alias("name"), key.alias("attr_key"), value.cast("double").alias("value_delta"))
        points = F.array(
            point("cost.usage", _pick(MODELS), F.col("value") / 1000),
            *(point("token.usage", F.lit(kind), v) for kind, v in (("input", k * 10), ("output", k * 3), ("cacheRead", k % 5 * 200), ("cacheCreation", k % 7 * 50))),
            point("active_time.total", F.lit(""), k),
        )
        return e.select("id", "session_id", "ts_ms", F.explode(points).alias("p")).select("id", "session_id", "ts_ms", "p.*")

    @property
    def tool_decisions(self) -> DataFrame:
        e = self.events_base.where("et = 'click'")
        return e.select("id", "session_id", "ts_ms", F.when(F.col("k") % 6 == 0, "reject").otherwise("accept").alias("decision"), _pick(SOURCES).alias("source"), _pick(TOOLS).alias("tool_name"))

    @property
    def tool_results(self) -> DataFrame:
        e = self.events_base.where("et = 'view'")
        k, tool = F.col("k"), _pick(TOOLS)
        return e.select("id", "session_id", "ts_ms", tool.alias("tool_name"), (k % 9 != 0).alias("success"), (k * 15).alias("duration_ms"), F.when(tool == "Bash", F.concat(F.lit("cmd "), k)).otherwise("").alias("bash_command"), F.when(tool.startswith("mcp__"), "srv").otherwise("").alias("mcp_server"))

    @property
    def events(self) -> DataFrame:
        e = self.events_base.where("et = 'signup'")
        k = F.col("k")
        attrs = F.when(k % 2 == 0, F.format_string('{"prompt_length":%d,"prompt":"p%d"}', k, k)).otherwise(F.format_string('{"prompt_length":%d}', k))
        return e.select("id", "session_id", "ts_ms", F.lit("user_prompt").alias("name"), attrs.alias("attrs_json"))

    @property
    def sessions(self) -> DataFrame:
        seen = self.events_base.groupBy("session_id").agg(F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"))
        first = self.api_requests.groupBy("session_id", "model").agg(F.min(F.struct("ts_ms", "id")).alias("at"))
        models = first.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]), ",").alias("model_set"))
        return seen.join(models, "session_id", "left").select(F.col("session_id").alias("id"), "first_seen", "last_seen", F.coalesce("model_set", F.lit("")).alias("model_set"))

    @property
    def raw_counter(self) -> DataFrame:
        """A cumulative counter by session: it restarts where k % 25 = 0; every eleventh k arrives late."""
        from pyspark.sql import Window

        order = Window.partitionBy("session_id").orderBy("ts_ms", "id")
        e = self.events_base.where("metric_axis and et = 'purchase'").withColumn("n", F.row_number().over(order)).withColumn("epoch", F.sum((F.col("k") % 25 == 0).cast("int")).over(order))
        inside = Window.partitionBy("session_id", "epoch").orderBy("ts_ms", "id")
        e = e.withColumn("value", F.sum(F.col("k") * 10).over(inside).cast("double")).withColumn("start_ms", F.min("ts_ms").over(Window.partitionBy("session_id", "epoch")))
        return e.select(F.col("session_id").alias("series"), "id", F.col("ts_ms").alias("time_ms"), "start_ms", "value", (F.col("n") + F.when(F.col("k") % 11 == 0, F.lit(3.5)).otherwise(F.lit(0.0))).alias("arrival"))
