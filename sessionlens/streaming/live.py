"""The live view as keyed state: for each viewer the current session, its cost with authority, and a minute of samples."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .delta_stream import ROCKSDB

#: A batch's session is that of its last row of the first of these kinds that it has; the burn window, and when a sample is stale.
PRIORITY = ("api", "result", "decision", "event", "metric", "session")
WINDOW_MS, STALE_MS = 60_000, 15_000
OUT = "who string, kind string, session_id string, dedup_key string, ts_ms bigint, cost_usd double, tokens bigint, active_sec double, last_tool string, usd_per_min double, tok_per_min double"
VIEWER = "session_id string, cost_usd double, tokens bigint, active_sec double, last_tool string, due bigint, chunks int, n_keys bigint, sample_ts array<bigint>, sample_cost array<double>, sample_tokens array<bigint>"
KEYS = "dedup_key array<string>, cost_usd array<double>, tokens array<bigint>, cost_source array<string>"
#: Groups that viewers are dealt to, as a call into Python for each costs more than its rows; and keys of a piece of state.
SHARDS, CHUNK = 1_024, 64


class _Keys:
    """The keys of a viewer's current session (key to cost, tokens, source of its request, or to None), in pieces of about CHUNK keys: a batch reads and writes only those that it falls into."""

    def __init__(self, state, who: str, chunks: int, n: int):
        self.state, self.who, self.chunks, self.n = state, who, chunks, n
        self.read: dict[int, dict[str, tuple | None]] = {}
        self.changed: set[int] = set()

    def _of(self, chunk: int) -> dict[str, tuple | None]:
        if chunk not in self.read:
            self.read[chunk] = {k: None if s is None else (c, t, s) for k, c, t, s in zip(*self.state.getValue((self.who, chunk)), strict=True)}
        return self.read[chunk]

    def _chunk(self, key: str) -> int:
        return zlib.crc32((key or "").encode()) % self.chunks

    def __contains__(self, key: str) -> bool:
        return key in self._of(self._chunk(key))

    def get(self, key: str) -> tuple | None:
        return self._of(self._chunk(key)).get(key)

    def put(self, key: str, value: tuple | None) -> None:
        chunk = self._chunk(key)
        self.n += key not in self._of(chunk)
        self.read[chunk][key] = value
        self.changed.add(chunk)

    def clear(self) -> None:
        """Forget all; the state has one empty piece after the next save()."""
        for chunk in range(1, self.chunks):
            self.state.removeKey((self.who, chunk))
        self.chunks, self.n, self.read, self.changed = 1, 0, {0: {}}, {0}

    def save(self) -> None:
        if self.n > CHUNK * self.chunks:
            whole = {k: v for chunk in range(self.chunks) for k, v in self._of(chunk).items()}
            while self.n > CHUNK * self.chunks:
                self.chunks *= 2
            self.read = {chunk: {} for chunk in range(self.chunks)}
            for k, v in whole.items():
                self.read[self._chunk(k)][k] = v
            self.changed = set(self.read)
        for chunk in sorted(self.changed):
            held = self.read[chunk]
            values = [v or (0.0, 0, None) for v in held.values()]
            self.state.updateValue((self.who, chunk), (list(held), *([v[k] for v in values] for k in range(3))))


class LiveView(StatefulProcessor):
    """A batch's rows of one viewer give a log event for each new key of the current session, and one tick with its totals.

    State is a shard's: by viewer totals, the samples of a minute and the keys of the current session; a switch of sessions clears them. A timer
    sends a tick without burn when no sample came for STALE_MS: it has the viewers of a batch, of whom those without a later one are stale.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.viewers = handle.getMapState("viewers", "who string", VIEWER)
        self.keys = handle.getMapState("keys", "who string, chunk int", KEYS)
        self.due = handle.getMapState("due", "at bigint", "who array<string>")

    def _session(self, rows: list) -> str:
        last = {row.kind: row.session_id for row in rows}
        return next((last[kind] for kind in PRIORITY if kind in last), "")

    def _fed(self, who: str, rows: list, due: int) -> list[tuple]:
        """A viewer's log events and tick from the batch's rows, in order of arrival; its state is brought up to date."""
        if self.viewers.containsKey((who,)):
            session, cost, tokens, active, tool, _, chunks, n, *samples = self.viewers.getValue((who,))
            keys = _Keys(self.keys, who, chunks, n)
        else:
            session, cost, tokens, active, tool, samples = "", 0.0, 0, 0.0, "", [[], [], []]
            keys = _Keys(self.keys, who, 1, 0)
            keys.clear()
        current = self._session(rows)
        if current != session:
            session, cost, tokens, active, tool, samples = current, 0.0, 0, 0.0, "", [[], [], []]
            keys.clear()
        out = []
        for row in rows:
            if row.session_id is None or row.session_id != session:
                continue
            new = row.kind not in ("metric", "session") and row.dedup_key not in keys
            if row.kind == "api":
                held = keys.get(row.dedup_key)
                if held is None or row.cost_source == "otlp" and held[2] != "otlp":
                    cost, tokens = cost + row.cost_usd - (held[0] if held else 0.0), tokens + int(row.tokens) - (held[1] if held else 0)
                    keys.put(row.dedup_key, (float(row.cost_usd), int(row.tokens), row.cost_source))
            elif new:
                keys.put(row.dedup_key, None)
            if row.kind == "metric":
                active += row.value
            if row.kind in ("result", "decision"):
                tool = row.tool_name
            if new:
                out.append((who, row.kind, session, row.dedup_key, int(row.ts_ms), float(row.cost_usd), int(row.tokens), 0.0, row.tool_name, 0.0, 0.0))
        keys.save()
        now = max(int(row.ts_ms) for row in rows)
        times, costs, counts = (list(x) for x in samples)
        times, costs, counts = [*times, now], [*costs, float(cost)], [*counts, int(tokens)]
        while len(times) > 1 and times[0] < now - WINDOW_MS:
            del times[0], costs[0], counts[0]
        self.viewers.updateValue((who,), (session, float(cost), int(tokens), float(active), tool, due, keys.chunks, keys.n, times, costs, counts))
        minutes = (times[-1] - times[0]) / 60_000
        burn = [max(0.0, (x[-1] - x[0]) / minutes) if minutes > 0 else 0.0 for x in (costs, counts)]
        return [*out, (who, "tick", session, "", now, float(cost), int(tokens), float(active), tool, *burn)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        by_viewer: dict[str, list] = {}
        for row in pd.concat(list(rows)).sort_values("arrival_seq").itertuples(index=False):
            by_viewer.setdefault(row.who, []).append(row)
        due = timerValues.getCurrentProcessingTimeInMs() + STALE_MS
        out = [x for who, own in by_viewer.items() for x in self._fed(who, own, due)]
        before = self.due.getValue((due,))[0] if self.due.containsKey((due,)) else ()
        self.due.updateValue((due,), ([*before, *by_viewer],))
        self.handle.registerTimer(due)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for who in self.due.getValue((at,))[0]:
            session, cost, tokens, active, tool, due, _, _, times, *_ = self.viewers.getValue((who,))
            if due == at:
                out.append((who, "tick", session, "", int(times[-1]), float(cost), int(tokens), float(active), tool, 0.0, 0.0))
        self.due.removeKey((at,))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def live_view(rows: DataFrame) -> DataFrame:
    """Ticks and log events of a stream of rows (who, kind, session_id, arrival_seq, dedup_key, ts_ms, cost_usd, tokens, cost_source, tool_name, value), for update mode.

    A viewer is whose sessions follow one another, such as a user; viewers are spread over tasks in shards. Of a trigger's ticks the last by viewer counts.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.withColumn("shard", F.pmod(F.xxhash64("who"), F.lit(SHARDS)).cast("int")).groupBy("shard").transformWithStateInPandas(LiveView(), OUT, "update", "processingTime")
