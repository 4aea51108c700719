"""What a terminal shows of a session: the status line, the report, the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines
from ..sources.adapter import Telemetry
from . import sessions, timeline

#: Fixed value: rows of a list if no number is asked for.
LAST = 10


def _chosen(t: Telemetry, session_id: str) -> str:
    """The asked session, or the latest if none is asked for; NotFound if there's none."""
    if session_id:
        sessions.require(t, session_id)
        return session_id
    latest = sessions.latest_session(t).first()
    if latest is None:
        raise sessions.NotFound
    return latest["id"]


def _of(rows: DataFrame, session_id: str) -> DataFrame:
    return rows.where(F.col("session_id") == session_id)


def status_line(t: Telemetry, session_id: str = "") -> str:
    """The session's status line; of one that isn't known the latest's, and an empty line if there's no session."""
    try:
        try:
            chosen = _chosen(t, session_id)
        except sessions.NotFound:
            chosen = _chosen(t, "")
    except sessions.NotFound:
        return ""
    return lines.status_line(sessions.snapshots(t).where(F.col("id") == chosen).first())


def last(t: Telemetry, session_id: str = "", n: int = LAST, tz: str = "UTC") -> list[str]:
    """The report's lines; only one session's rows reach the driver: its rejected calls and n results and prompts."""
    chosen, n = _chosen(t, session_id), n if n > 0 else LAST
    snapshot = sessions.snapshots(t).where(F.col("id") == chosen).first()
    rejects = _of(t.tool_decisions, chosen).where("decision = 'reject'").orderBy("ts_ms", "id").toLocalIterator()
    newest = lambda rows: reversed(rows.orderBy(F.desc("ts_ms"), F.desc("id")).limit(n).collect())
    prompts = timeline.prompt_fields(_of(t.events, chosen).where("name = 'user_prompt'"))
    prompts = prompts.select("ts_ms", "id", F.coalesce("prompt_length", F.lit(0)).alias("prompt_length"), "prompt", F.col("prompt").isNotNull().alias("stored"))
    return lines.report(snapshot, rejects, newest(_of(t.tool_results, chosen)), newest(prompts), n, tz)


def tail(t: Telemetry, session_id: str = "", n: int = LAST, tz: str = "UTC") -> list[str]:
    """The newest n log lines, of one session or of all, oldest first."""
    rows = timeline.log_rows(t) if not session_id else _of(timeline.log_rows(t), session_id)
    return [lines.tail_line(r, tz) for r in reversed(rows.orderBy(F.desc("ts_ms"), F.desc("seq"), F.desc("id")).limit(n).collect())]
