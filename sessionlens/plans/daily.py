"""Daily heatmap and headline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapter import Telemetry
from .cost import cost_series


def days(t: Telemetry, tz: str = "UTC") -> DataFrame:
    """Tokens, cost and cached tokens by local day of the hour bucket's start, without gaps between the first day and the last."""
    hours = cost_series(t, "hour")
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("ts"), tz))
    daily = hours.groupBy(day.alias("day")).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.sum("cache_read").alias("cache_read"))
    grid = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return grid.join(daily, "day", "left").select("day", zero("tokens"), F.round(F.coalesce("cost_usd", F.lit(0.0)), 6).alias("cost_usd"), zero("cache_read"))


def heatmap(t: Telemetry, tz: str = "UTC") -> DataFrame:
    """Each day's level 0 to 4 by the quartiles of the days with tokens, and whether its month begins there."""
    rows = days(t, tz)
    positive = rows.where("tokens > 0").agg(F.sort_array(F.collect_list("tokens")).alias("p"))  # as many as days
    at = lambda q: F.element_at("p", F.least(F.size("p"), F.floor(F.lit(q) * F.size("p")).cast("int") + 1))
    cuts = positive.where("size(p) > 0").select(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    level = F.when(F.col("tokens") <= 0, 0).when(F.col("tokens") <= F.col("q1"), 1).when(F.col("tokens") <= F.col("q2"), 2).when(F.col("tokens") <= F.col("q3"), 3).otherwise(4)
    month = F.month("day")
    label = F.coalesce(month != F.lag(month).over(Window.orderBy("day")), F.lit(True))
    return rows.join(cuts, how="left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "tokens", "cost_usd", level.cast("bigint").alias("level"), label.alias("new_month"))


def headline(t: Telemetry, tz: str = "UTC") -> DataFrame:
    """One row: totals, active days, and the busiest day, the earliest of equals."""
    busiest = F.max_by("day", F.struct("tokens", -F.datediff("day", F.lit("1970-01-01"))))
    return days(t, tz).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count_if(F.col("tokens") > 0).alias("active_days"), F.date_format(busiest, "yyyy-MM-dd").alias("busiest_day"))
