"""What was received, accepted and rejected, counted while the rows go by."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Why rows are rejected; each has a counter of its own.
REASONS = ("unsupported shape", "no value", "not finite")


def of_transcripts() -> dict[str, Column]:
    kind = F.col("kind")
    return {"received": F.count_if(kind.isin("malformed", "session")), "malformed": F.count_if(kind == "malformed"), "accepted": F.count_if(~kind.isin("malformed", "session"))}


def of_logs() -> dict[str, Column]:
    return {"received": F.count(F.lit(1)), "accepted": F.count(F.lit(1))}


def of_metrics() -> dict[str, Column]:
    rejected = {f"rejected {reason}": F.count_if(F.col("reason") == reason) for reason in REASONS}
    return {"received": F.count(F.lit(1)), "accepted": F.count_if(F.col("kind") == "accepted")} | rejected


def observed(rows: DataFrame, name: str, counters: dict[str, Column]) -> DataFrame:
    """rows, counted under a name as they are read; a StreamCounters or the query's progress has the counts of a stream."""
    return rows.observe(name, *(c.cast("long").alias(n) for n, c in counters.items()))


class StreamCounters(StreamingQueryListener):
    """Sums of the counts of all streams of a session from the time that it is added: totals["name", "counter"]."""

    def __init__(self) -> None:
        super().__init__()
        self.totals: Counter[tuple[str, str]] = Counter()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            for counter, n in row.asDict().items():
                self.totals[name, counter] += n or 0

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def health(spark: SparkSession, counts: dict[tuple[str, str], int], policy: str = "") -> DataFrame:
    """One row: status, units received, rows accepted, units rejected for good with the reason, and the retention policy."""
    total = lambda counter: sum(n for (_, c), n in counts.items() if c == counter)
    rejected = {reason.replace(" ", "_"): total(f"rejected {reason}") for reason in REASONS} | {"malformed": total("malformed")}
    row = {"status": "ok", "received": total("received"), "accepted": total("accepted"), "rejected_permanent": sum(rejected.values())} | rejected | {"policy": policy}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'string' if isinstance(v, str) else 'long'}" for c, v in row.items()))


def policy(retention_days: int, max_sessions: int) -> str:
    """How retention reads in a health row; 0 turns a rule off."""
    parts = [f"{retention_days}d"] * (retention_days > 0) + [f"{max_sessions} sessions"] * (max_sessions > 0)
    return " or ".join(parts) or "none"
