"""Pairing tool results with the tool uses before them, across micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import transcript
from .delta_stream import ROCKSDB

#: A use that got no result for so long is given up; and the groups that calls are dealt to, as a call into Python for each costs more than its rows.
PATIENCE_MS, SHARDS = 3_600_000, 1_024
OUT = "file string, tool_use_id string, session_id string, ts_ms bigint, success boolean, tool_name string, command string, use_ms bigint"


class Pairing(StatefulProcessor):
    """The open uses of a shard's calls. A later use takes an open one's place, a result takes it away, and the state's time to live gives it up."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "file string, tool_use_id string", "tool_name string, command string, use_ms bigint", self.patience_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        left: dict[tuple[str, str], tuple | None] = {}  # what the batch leaves open of each of its calls
        out = []
        for row in pd.concat(list(rows)).sort_values(["pos", "index"]).itertuples(index=False):
            call = (row.file, row.tool_use_id)
            if row.is_use:
                left[call] = (row.tool_name, row.command, int(row.ts_ms))
            else:
                use = left[call] if call in left else self.open.getValue(call) if self.open.containsKey(call) else None
                out.append((*call, row.session_id, int(row.ts_ms), bool(row.success), *(use or (None, None, None))))
                left[call] = None
        for call, use in left.items():
            if use is not None:
                self.open.updateValue(call, use)
            elif self.open.containsKey(call):
                self.open.removeKey(call)
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    return frame.astype({"ts_ms": "int64", "use_ms": "Int64", "success": "bool"})


def tool_results(decoded: DataFrame, store_text: bool = True, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """Streaming form of transcript.tool_results(): decoded is transcript.decode() of a stream of lines; a result goes out in the batch that it comes in.

    One state row for each open call, in shards by (file, call id); none for calls that are over. Results without an id never pair and pass by.
    """
    decoded.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    calls = decoded.where("kind in ('use', 'result')").select("file", F.coalesce("tool_use_id", F.lit("")).alias("tool_use_id"), "pos", "index", (F.col("kind") == "use").alias("is_use"), "session_id", "ts_ms", F.coalesce("success", F.lit(False)).alias("success"), F.coalesce("tool_name", F.lit("")).alias("tool_name"), F.coalesce("text", F.lit("")).alias("command"))
    shard = F.pmod(F.xxhash64("file", "tool_use_id"), F.lit(SHARDS)).cast("int")
    paired = calls.where("tool_use_id <> ''").withColumn("shard", shard).groupBy("shard").transformWithStateInPandas(Pairing(patience_ms), OUT, "append", "processingTime")
    nameless = calls.where("tool_use_id = '' and not is_use").select("file", "tool_use_id", "session_id", "ts_ms", "success", *(F.lit(None).cast(t).alias(c) for c, t in (("tool_name", "string"), ("command", "string"), ("use_ms", "bigint"))))
    return transcript.finished(paired.union(nameless), store_text)
