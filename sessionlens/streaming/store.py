"""Stored tables that change together: one commit names the state of all of them, in buckets that split as they grow."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge

#: Commits that readers may still hold, rows of a bucket from which it splits, and how often a bucket can have split.
KEPT, BUCKET_ROWS, DEEPEST = 2, 1_000_000, 40


@dataclass(frozen=True)
class Table:
    """key: what rows of one key are merged by; merged: one row a key from the rows held and the new ones."""

    key: tuple[str, ...]
    merged: Callable[[DataFrame], DataFrame]


def _first(*key: str) -> Table:
    return Table(key, lambda rows: merge.insert_ignore(rows, list(key)))


#: The telemetry tables. Every row has an arrival_seq; that of a later batch is larger.
TABLES = {
    "sessions": Table(("id",), lambda rows: merge.merge_sessions(rows, keep_seq=True)),
    "api_requests": Table(("dedup_key",), merge.cost_authority),
    "tool_decisions": _first("dedup_key"),
    "tool_results": _first("dedup_key"),
    "events": _first("dedup_key"),
    "spans": _first("trace_id", "span_id"),
    "metric_points": _first("series_key", "start_ns", "time_ns"),
    "series_state": Table(("series_key",), lambda rows: rows.groupBy("series_key").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "series_key")), "arrival_seq").alias("_last")).select("series_key", "_last.*").select(*rows.columns)),
}
CHILDREN = ("api_requests", "tool_decisions", "tool_results", "events", "spans", "metric_points")


@dataclass(frozen=True)
class Bucket:
    """Rows whose hash ends in `code`, by `depth` bits."""

    depth: int
    code: int
    path: str
    rows: int


class Store:
    """Tables below a folder of any file system that Spark writes to. One writer at a time; any number of readers.

    A write merges new rows into the buckets that they fall into and leaves all others alone, so what it writes follows the batch and not the
    table. Nothing counts until commits/<n>.json is there, which names every bucket of every table, so a failure at any point leaves the last
    state of all tables, and a batch that comes again is skipped. A bucket with over `bucket_rows` rows splits when it is next written.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table] | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.tables, self.bucket_rows = spark, path.rstrip("/"), TABLES if tables is None else tables, bucket_rows
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.written_rows = 0

    def _numbers(self) -> list[int]:
        folder = self._jpath(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _commit(self, number: int) -> dict:
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.path}/commits/{number}.json").first()[0])

    def _state(self) -> tuple[int, dict]:
        numbers = self._numbers()
        return (numbers[-1], self._commit(numbers[-1])) if numbers else (0, {"batch": -1, "schemas": {}, "tables": {}})

    def batch(self) -> int:
        """The last batch that is in, -1 if none is."""
        return self._state()[1]["batch"]

    def read(self, name: str) -> DataFrame | None:
        """A table as of the newest commit; None if it never had a row."""
        state = self._state()[1]
        return self._rows(state, name, [Bucket(**b) for b in state["tables"].get(name, [])])

    def _rows(self, state: dict, name: str, buckets: list[Bucket]) -> DataFrame | None:
        if name not in state["schemas"]:
            return None
        schema = state["schemas"][name]
        paths = [f"{self.path}/{b.path}" for b in buckets if b.rows]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _placed(self, name: str, rows: DataFrame, buckets: list[Bucket]) -> DataFrame:
        """rows with `_hash` and `_bucket`, the index of theirs among the buckets."""
        rows = rows.withColumn("_hash", F.xxhash64(*self.tables[name].key))
        places = self.spark.createDataFrame([(b.depth, b.code, k) for k, b in enumerate(buckets)], "_depth int, _code long, _bucket int")
        depths = sorted({b.depth for b in buckets})
        ends = F.array(*(F.struct(F.lit(d).alias("_depth"), F.col("_hash").bitwiseAND(F.lit((1 << d) - 1)).alias("_code")) for d in depths))
        return rows.select("*", F.inline(ends)).join(F.broadcast(places), ["_depth", "_code"]).drop("_depth", "_code")

    def _rewritten(self, name: str, state: dict, rows: DataFrame, arriving: dict[int, int]) -> list[dict]:
        """The table's buckets after those in `arriving` (index to number of new rows) hold exactly `rows`, which have `_hash` and `_bucket`."""
        buckets = [Bucket(**b) for b in state["tables"].get(name, [])] or [Bucket(0, 0, "", 0)]
        deeper = {k: min(DEEPEST, buckets[k].depth + max(0, math.ceil(math.log2(max(1, buckets[k].rows + n) / self.bucket_rows)))) for k, n in arriving.items()}
        depths = self.spark.createDataFrame(list(deeper.items()), "_bucket int, _depth int")
        code = F.col("_hash").bitwiseAND(F.expr("shiftleft(1L, _depth) - 1"))
        place = F.concat_ws("-", "_depth", code)
        folder = f"{name}/{uuid.uuid4().hex}"
        out = rows.join(F.broadcast(depths), "_bucket").withColumn("_place", place).drop("_hash", "_bucket", "_depth")
        out.repartition("_place").write.partitionBy("_place").parquet(f"{self.path}/{folder}")
        counted = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("_place").count().collect() if self._has_files(folder) else []
        there = {r[0]: r[1] for r in counted}  # a row a bucket written
        self.written_rows += sum(there.values())
        new = []
        for k, depth in deeper.items():
            for high in range(1 << (depth - buckets[k].depth)):
                at = buckets[k].code | high << buckets[k].depth
                n = there.get(f"{depth}-{at}", 0)
                new.append({"depth": depth, "code": at, "path": f"{folder}/_place={depth}-{at}" if n else "", "rows": n})
        return [vars(b) for k, b in enumerate(buckets) if k not in deeper] + new

    def _has_files(self, folder: str) -> bool:
        return any(s.isDirectory() for s in self._fs.listStatus(self._jpath(f"{self.path}/{folder}")))

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        """Merge a batch's new rows into their tables, in one commit; for foreachBatch. A batch that is in already is skipped."""
        number, state = self._state()
        if state["batch"] >= batch_id:
            return
        changed, schemas = {}, dict(state["schemas"])
        for name, rows in tables.items():
            buckets = [Bucket(**b) for b in state["tables"].get(name, [])] or [Bucket(0, 0, "", 0)]
            placed = self._placed(name, rows, buckets).persist()
            try:
                arriving = {r[0]: r[1] for r in placed.groupBy("_bucket").count().collect()}  # a row a bucket at most
                if not arriving:
                    continue
                held = self._rows(state, name, [buckets[k] for k in arriving])
                whole = placed.drop("_hash", "_bucket")
                merged = self.tables[name].merged(whole if held is None else held.unionByName(whole, allowMissingColumns=True))
                changed[name] = self._rewritten(name, state, self._placed(name, merged, buckets), arriving)
                schemas[name] = _ddl(merged)
            finally:
                placed.unpersist()
        self._publish(number, {"batch": batch_id, "schemas": schemas, "tables": state["tables"] | changed})

    def delete(self, gone: dict[str, DataFrame]) -> None:
        """Delete rows from several tables in one commit. gone: by table, rows of its key columns, or of others that it has; rows equal in them go."""
        number, state = self._state()
        changed = {}
        for name, keys in gone.items():
            buckets = [Bucket(**b) for b in state["tables"].get(name, [])]
            rows = self._rows(state, name, buckets)
            if rows is None:
                continue
            rows = self._placed(name, rows, buckets)
            touched = {r[0]: 0 for r in rows.join(keys, keys.columns, "left_semi").select("_bucket").distinct().collect()}
            if touched:
                held = self._placed(name, self._rows(state, name, [buckets[k] for k in touched]), buckets)
                changed[name] = self._rewritten(name, state, held.join(keys, keys.columns, "left_anti").select(*held.columns), touched)
        if changed:
            self._publish(number, state | {"tables": state["tables"] | changed})

    def retain(self, now_ms: int, max_age_ms: int, cap: int) -> None:
        """Sessions beyond an age or a number go, with their rows in all tables and the cursors of series that have no point left, in one commit."""
        sessions = self.read("sessions")
        if sessions is None:
            return
        gone = sessions.join(merge.retained_sessions(sessions, now_ms, max_age_ms, cap).select("id"), "id", "left_anti").select("id")
        by_session = gone.select(F.col("id").alias("session_id"))
        deleted = {"sessions": gone} | {name: by_session for name in CHILDREN if name in self.tables}
        points, cursors = self.read("metric_points"), self.read("series_state")
        if cursors is not None:
            left = cursors.where("false") if points is None else points.join(by_session, "session_id", "left_anti")
            deleted["series_state"] = merge.orphan_series(cursors, left).select("series_key")
        self.delete(deleted)

    def _publish(self, number: int, state: dict) -> None:
        out = self._fs.create(self._jpath(f"{self.path}/commits/.{number + 1}.tmp"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(self._jpath(f"{self.path}/commits/.{number + 1}.tmp"), self._jpath(f"{self.path}/commits/{number + 1}.json")):
            raise OSError(f"commit {number + 1} could not be made")
        self._forget()

    def _forget(self) -> None:
        """Delete what only commits before the last KEPT name."""
        numbers = self._numbers()
        paths = lambda state: {b["path"] for buckets in state["tables"].values() for b in buckets if b["path"]}
        used = set().union(*(paths(self._commit(n)) for n in numbers[-KEPT:]))
        for n in numbers[:-KEPT]:
            for path in paths(self._commit(n)) - used:
                self._fs.delete(self._jpath(f"{self.path}/{path}"), True)
            self._fs.delete(self._jpath(f"{self.path}/commits/{n}.json"), False)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
