"""Cumulative counters to deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def arrival_window(seq: str):
    return Window.partitionBy("series").orderBy(seq)


def normalize(points: DataFrame, seq: str = "arrival") -> DataFrame:
    """series, time_ms, start_ms, value, delta, rule of accepted points.

    In order of arrival: a point older than any accepted before is stale and dropped; the first is a baseline of 0; a new start or a
    fallen value is a reset and counts in full; else the growth counts. Stale points never raise the high-water mark, so it is a running
    maximum of earlier arrivals, and the rest is a lag over what stays.
    """
    arrived = arrival_window(seq)
    kept = points.withColumn("_high", F.max("time_ms").over(arrived.rowsBetween(Window.unboundedPreceding, -1))).where("_high is null or time_ms >= _high").drop("_high")
    kept = kept.withColumn("_value", F.lag("value").over(arrived)).withColumn("_start", F.lag("start_ms").over(arrived))
    reset = (F.col("start_ms") != F.col("_start")) | (F.col("value") < F.col("_value"))
    rule = F.when(F.col("_value").isNull(), "baseline").when(reset, "reset").otherwise("normal")
    delta = F.when(F.col("_value").isNull(), F.lit(0.0)).when(reset, F.col("value")).otherwise(F.col("value") - F.col("_value"))
    return kept.withColumn("rule", rule).withColumn("delta", delta).drop("_value", "_start")


def normalize_mixed(points: DataFrame, seq: str = "arrival") -> DataFrame:
    """As normalize(), for points with a `temporality` (1 delta, 2 or 0 cumulative): series of one temporality take the window form, mixed ones a fold by series."""
    kinds = points.groupBy("series").agg(F.min(F.col("temporality") == 1).alias("_all"), F.max(F.col("temporality") == 1).alias("_any"))
    marked = points.join(kinds, "series")
    whole = marked.where("_all").drop("_all", "_any").withColumn("rule", F.lit("delta")).withColumn("delta", F.col("value"))
    cumulative = normalize(marked.where("not _any").drop("_all", "_any"), seq)
    mixed = marked.where("_any and not _all").drop("_all", "_any")
    schema = whole.schema

    def fold(group):
        rows, last = [], None
        for row in group.sort_values(seq).to_dict("records"):
            if row["temporality"] == 1:
                rows.append(row | {"rule": "delta", "delta": row["value"]})
            elif last is None:
                rows.append(row | {"rule": "baseline", "delta": 0.0})
            elif row["time_ms"] < last["time_ms"]:
                continue
            elif row["start_ms"] != last["start_ms"] or row["value"] < last["value"]:
                rows.append(row | {"rule": "reset", "delta": row["value"]})
            else:
                rows.append(row | {"rule": "normal", "delta": row["value"] - last["value"]})
            last = row
        import pandas as pd

        return pd.DataFrame(rows, columns=schema.names)

    return whole.unionByName(cumulative).unionByName(mixed.groupBy("series").applyInPandas(fold, schema))


def cursors(points: DataFrame, seq: str = "arrival") -> DataFrame:
    """series, value, start_ms, time_ms of the last point that each series accepted: where a stream that follows goes on."""
    accepted = normalize_mixed(points, seq)
    return accepted.groupBy("series").agg(F.max_by(F.struct("value", "start_ms", "time_ms"), F.col(seq)).alias("_last")).select("series", "_last.*")
