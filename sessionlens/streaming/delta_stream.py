"""Streaming delta normalisation, one cursor a series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "series string, time_ms bigint, value double, delta double, rule string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DeltaNormalizer(StatefulProcessor):
    """The state machine of operators.delta: stale points are dropped, the first is a baseline, a reset counts in full."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "value double, start_ms bigint, time_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.cursor.get() if self.cursor.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples(index=False):
            if row.temporality == 1:
                out.append((key[0], row.time_ms, row.value, row.value, "delta"))
            elif last is None:
                out.append((key[0], row.time_ms, row.value, 0.0, "baseline"))
            elif row.time_ms < last[2]:
                continue
            elif row.start_ms != last[1] or row.value < last[0]:
                out.append((key[0], row.time_ms, row.value, row.value, "reset"))
            else:
                out.append((key[0], row.time_ms, row.value, row.value - last[0], "normal"))
            last = (float(row.value), int(row.start_ms), int(row.time_ms))
        if last is not None:
            self.cursor.update(last)
        yield pd.DataFrame(out, columns=["series", "time_ms", "value", "delta", "rule"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self.cursor.update((float(row["value"]), int(row["start_ms"]), int(row["time_ms"])))

    def close(self) -> None:
        pass


def normalize_stream(points: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """points: series, arrival, time_ms, start_ms, value, temporality. cursors (series, value, start_ms, time_ms): where a new stream takes up
    series that a batch has read before it, so that they get no second baseline; a stream with a checkpoint goes on from that alone."""
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    seed = None if cursors is None else cursors.select("series", "value", "start_ms", "time_ms").groupBy("series")
    return points.groupBy("series").transformWithStateInPandas(DeltaNormalizer(), OUT, "append", "none", seed)
