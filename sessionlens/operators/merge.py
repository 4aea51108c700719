"""Merging re-delivered rows: first writer wins, authoritative cost wins, sessions widen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COST_COLUMNS = ("cost_usd", "input_tokens", "output_tokens", "cache_read", "cache_creation", "duration_ms", "is_error", "status_code", "cost_source")


def insert_ignore(rows: DataFrame, key: list[str], seq: str = "arrival_seq", target: DataFrame | None = None) -> DataFrame:
    """The first arrival of each key, by an aggregate with map-side combining; with a target, only keys that it doesn't hold yet."""
    own = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*own), F.col(seq)).alias("_first")).select(*key, "_first.*").select(*rows.columns)
    return first if target is None else first.join(target.select(*key).distinct(), key, "left_anti")


def cost_authority(rows: DataFrame, key: str = "dedup_key", seq: str = "arrival_seq") -> DataFrame:
    """One row a key: cost columns of the first authoritative ('otlp') arrival, else of the first; all others of the first arrival."""
    own = [c for c in rows.columns if c not in (key, *COST_COLUMNS)]
    rank = F.when(F.col("cost_source") == "otlp", 0).otherwise(1)
    merged = rows.groupBy(key).agg(
        F.min_by(F.struct(*own), F.col(seq)).alias("own"),
        F.min_by(F.struct(*(c for c in rows.columns if c in COST_COLUMNS)), F.struct(rank, F.col(seq))).alias("cost"),
    )
    return merged.select(key, "own.*", "cost.*").select(*rows.columns)


def _latest(column: str, seq: str) -> Column:
    """The last value that isn't empty."""
    return F.coalesce(F.max_by(column, F.when(F.col(column) != "", F.col(seq))), F.lit(""))


def merge_sessions(rows: DataFrame, seq: str = "arrival_seq", keep_seq: bool = False) -> DataFrame:
    """One row an id: earliest and latest sight, last non-empty texts, sticky has_events; with the latest arrival if it is to be merged again."""
    texts = [c for c in ("app_version", "model_set", "user_email", "org_id", "token_source", "repo", "git_branch") if c in rows.columns]
    more = [F.max("has_events").alias("has_events")] if "has_events" in rows.columns else []
    more += [F.max(seq).alias(seq)] if keep_seq else []
    return rows.groupBy("id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *(_latest(c, seq).alias(c) for c in texts), *more)


def with_missing_sessions(sessions: DataFrame, *children: DataFrame) -> DataFrame:
    """sessions, and a bare row for every session id that only children have."""
    ids = None
    for child in children:
        part = child.groupBy("session_id").agg(F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"))
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.groupBy(F.coalesce("session_id", F.lit("")).alias("id")).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return sessions.unionByName(ids.join(sessions, "id", "left_anti"), allowMissingColumns=True)


def retained_sessions(sessions: DataFrame, now_ms: int, max_age_ms: int, cap: int) -> DataFrame:
    """Sessions young enough and among the `cap` latest; an age or a cap of 0 or less turns that rule off. The rank is found by a distributed top-k, not a global window."""
    young = sessions.where(F.col("last_seen") >= now_ms - max_age_ms) if max_age_ms > 0 else sessions
    return young.orderBy(F.desc("last_seen"), F.desc("id")).limit(cap) if cap > 0 else young


def retained_children(children: DataFrame, survivors: DataFrame) -> DataFrame:
    return children.join(survivors.select(F.col("id").alias("session_id")), "session_id", "left_semi")


def orphan_series(state: DataFrame, metric_points: DataFrame) -> DataFrame:
    """Cursors of series that no longer have a point."""
    return state.join(metric_points.select("series_key").distinct(), "series_key", "left_anti")
