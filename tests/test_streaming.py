"""Streaming equals batch; the live view; idempotent batches."""

import json
import random
import time

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from sessionlens.operators import delta, merge
from sessionlens.sources import append_jsonl, counters, transcript
from sessionlens.streaming import live, pair_stream, runs
from sessionlens.streaming.delta_stream import normalize_stream



def call(kind, call_id, n):
    """A transcript line with a tool use or a tool result."""
    if kind == "use":
        content, role = {"type": "tool_use", "id": call_id, "name": "Bash", "input": {"command": f"run {n}"}}, "assistant"
    else:
        content, role = {"type": "tool_result", "tool_use_id": call_id, "is_error": n % 3 == 0}, "user"
    return json.dumps({"type": role, "uuid": f"u{n}", "sessionId": "s", "timestamp": f"2026-01-01T00:00:01.{n % 1000:03}Z", "message": {"role": role, "content": [content]}}) + "\n"


def follow(spark, tmp_path, patience_ms=3_600_000):
    """One start on the same checkpoint, with all that has been written until now."""
    lines = append_jsonl.follow(spark, str(tmp_path / "in"), str(tmp_path / "ck"), 0, 300).withColumnRenamed("offset", "pos")
    results = pair_stream.tool_results(transcript.decode(lines), patience_ms=patience_ms)
    runs.run_available(spark, results.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")))
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("seed", [1, 2])
def test_pairing_with_random_cuts_equals_batch(spark, tmp_path, seed):
    """Files grow by any number of bytes between starts; ids are used again, results come twice, alone, or without an id."""
    rng = random.Random(seed)
    (tmp_path / "in").mkdir()
    texts = {f"{name}.jsonl": "".join(call(rng.choice(["use", "use", "result"]), rng.choice(["a", "b", "c", "d", ""]), n) for n in range(30)).encode() for name in "xy"}
    cuts = {name: sorted(rng.randrange(len(text)) for _ in range(3)) for name, text in texts.items()}
    for step in range(4):
        for name, text in texts.items():
            (tmp_path / "in" / name).write_bytes(text[: [*cuts[name], len(text)][step]])
        got = follow(spark, tmp_path)
    want = transcript.tool_results(transcript.decode(transcript.read_lines(spark, str(tmp_path / "in"))))
    assert got.count() > 10 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_a_use_without_result_is_given_up(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "a.jsonl"
    path.write_text(call("use", "late", 1) + call("use", "soon", 2))
    follow(spark, tmp_path, patience_ms=1)
    time.sleep(0.2)
    with path.open("a") as f:
        f.write(call("result", "other", 3))
    follow(spark, tmp_path, patience_ms=1)  # timers fire in this batch
    with path.open("a") as f:
        f.write(call("result", "late", 4))
    got = {r["tool_use_id"]: r["tool_name"] for r in follow(spark, tmp_path, patience_ms=1).collect()}
    assert got == {"other": "", "late": ""}


class Held:
    """A map state in memory that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getMapState(self, *_):  # noqa: N802
        return self

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.rows

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.rows[key]


def test_one_group_pairs_many_calls():
    held, pairing = Held(), pair_stream.Pairing(1)
    pairing.init(held)
    row = lambda n, pos, is_use: ("f", f"t{n}", pos, 0, is_use, "s", pos, True, f"tool{n}", "")
    columns = ["file", "tool_use_id", "pos", "index", "is_use", "session_id", "ts_ms", "success", "tool_name", "command"]
    feed = lambda rows: {r.tool_use_id: r.tool_name for r in pd.concat(pairing.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), None)).itertuples()}
    assert feed([row(n, n, True) for n in range(20)] + [row(n, 100 + n, False) for n in range(10)]) == {f"t{n}": f"tool{n}" for n in range(10)}
    assert set(held.rows) == {("f", f"t{n}") for n in range(10, 20)} and held.calls == 20
    assert feed([row(n, 200 + n, False) for n in range(5, 15)]) == {f"t{n}": None if n < 10 else f"tool{n}" for n in range(5, 15)} and len(held.rows) == 5


SCHEMA = "series string, arrival int, time_ms bigint, start_ms bigint, value double, temporality int"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, 1, 0, 10.0, 2), ("a", 2, 2, 0, 15.0, 2), ("b", 3, 1, 0, 5.0, 2), ("a", 4, 1, 0, 99.0, 2), ("a", 5, 3, 0, 4.0, 2), ("b", 6, 2, 0, 9.0, 2)]
    for n in range(2):
        spark.createDataFrame(rows[n * 3 : n * 3 + 3], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = normalize_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = sorted((r["series"], r["time_ms"], r["delta"], r["rule"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r["series"], r["time_ms"], r["delta"], r["rule"]) for r in delta.normalize(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want


class Live:
    """What the live view has to show, row by row: fed with one viewer's batches."""

    def __init__(self):
        self.session, self.costs, self.seen, self.active, self.tool, self.samples = "", {}, set(), 0.0, "", []

    def feed(self, rows):
        rows = sorted(rows, key=lambda r: r["arrival_seq"])
        current = next([r for r in rows if r["kind"] == k][-1]["session_id"] for k in live.PRIORITY if any(r["kind"] == k for r in rows))
        if current != self.session:
            self.__init__()
            self.session = current
        events = []
        for r in rows:
            if r["session_id"] != self.session:
                continue
            if r["kind"] == "api":
                held = self.costs.get(r["dedup_key"])
                if held is None or r["cost_source"] == "otlp" != held[2]:
                    self.costs[r["dedup_key"]] = (r["cost_usd"], r["tokens"], r["cost_source"])
            self.active += r["value"] if r["kind"] == "metric" else 0
            self.tool = r["tool_name"] if r["kind"] in ("result", "decision") else self.tool
            if r["kind"] not in ("metric", "session") and r["dedup_key"] not in self.seen:
                self.seen.add(r["dedup_key"])
                events.append(r["dedup_key"])
        now = max(r["ts_ms"] for r in rows)
        cost, tokens = (sum(c[k] for c in self.costs.values()) for k in (0, 1))
        self.samples = [x for x in self.samples if x[0] >= now - live.WINDOW_MS] + [(now, cost, tokens)]
        minutes = (now - self.samples[0][0]) / 60_000
        burn = tuple(round(max(0.0, (self.samples[-1][k] - self.samples[0][k]) / minutes), 6) if minutes > 0 else 0.0 for k in (1, 2))
        return sorted(events), (self.session, now, round(cost, 6), tokens, round(self.active, 6), self.tool, *burn)


LIVE = "who string, kind string, session_id string, arrival_seq bigint, dedup_key string, ts_ms bigint, cost_usd double, tokens bigint, cost_source string, tool_name string, value double"


def live_rows(rng, begin, n):
    kinds = [rng.choice(live.PRIORITY) for _ in range(n)]
    return [{"who": rng.choice("vw"), "kind": k, "session_id": rng.choice("sst"), "arrival_seq": begin + i, "dedup_key": f"k{rng.randrange(12)}", "ts_ms": (begin + i) * 1000, "cost_usd": rng.choice([0.25, 0.5, 1.0]), "tokens": rng.randrange(9), "cost_source": rng.choice(["otlp", "jsonl-estimate"]), "tool_name": rng.choice(["Bash", "Edit"]), "value": 0.5} for i, k in enumerate(kinds)]


@pytest.mark.parametrize("seed", [3])
def test_live_view_equals_the_fold_over_restarts(spark, tmp_path, seed):
    rng = random.Random(seed)
    folds, got = {w: Live() for w in "vw"}, []
    for batch in range(5):
        rows = live_rows(rng, batch * 20, 14)
        spark.createDataFrame([tuple(r.values()) for r in rows], LIVE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LIVE).parquet(str(tmp_path / "in"))
        got.clear()
        runs.run_available(spark, live.live_view(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")))
        for who, fold in folds.items():
            own = [r for r in rows if r["who"] == who]
            if own:
                events, tick = fold.feed(own)
                assert sorted(r["dedup_key"] for r in got if r["who"] == who and r["kind"] != "tick") == events
                seen = next(r for r in got if r["who"] == who and r["kind"] == "tick")
                assert (seen["session_id"], seen["ts_ms"], round(seen["cost_usd"], 6), seen["tokens"], round(seen["active_sec"], 6), seen["last_tool"], round(seen["usd_per_min"], 6), round(seen["tok_per_min"], 6)) == tick


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.now


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Held())

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_one_group_shows_many_viewers():
    """Also: keys in many pieces, of which a small batch touches few; a switch leaves none behind; timers send a tick for those without a later batch."""
    rng = random.Random(4)
    handle, view = Handle(), live.LiveView()
    view.init(handle)
    whos = [None, *(f"v{n}" for n in range(9))]
    folds = {w: Live() for w in whos}
    for step in range(6):
        rows = [r | {"who": w, "dedup_key": f"k{rng.randrange(400)}", "session_id": "s" if step < 5 or w != "v3" else "t"} for w in whos if w != "v8" or not step for r in live_rows(rng, step * 200, 180)]
        rng.shuffle(rows)
        before = sum(s.calls for s in handle.states.values())
        got = pd.concat(view.handleInputRows((0,), iter([pd.DataFrame(rows)]), Clock(step))).astype({"who": object})
        assert step < 5 or sum(s.calls for s in handle.states.values()) - before < 400  # 1,620 rows
        for who, fold in folds.items():
            own = [r for r in rows if r["who"] == who]
            if own:
                events, tick = fold.feed(own)
                mine = [r for r in got.itertuples() if r.who == who]
                seen = mine[-1]
                assert sorted(r.dedup_key for r in mine if r.kind != "tick") == events
                assert (seen.session_id, seen.ts_ms, round(seen.cost_usd, 6), seen.tokens, round(seen.active_sec, 6), seen.last_tool, round(seen.usd_per_min, 6), round(seen.tok_per_min, 6)) == tick
    chunks = {w: v[6] for (w,), v in handle.states["viewers"].rows.items()}
    assert chunks["v1"] > 4 and sorted(handle.states["keys"].rows, key=str) == sorted(((w, c) for w, n in chunks.items() for c in range(n)), key=str)
    stale = [pd.concat(view.handleExpiredTimer((0,), None, Clock(at))) for at in handle.timers]
    assert [sorted(map(str, f["who"])) for f in stale] == [["v8"], [], [], [], [], sorted(str(w) for w in whos if w != "v8")] and not handle.states["due"].rows


def test_seeded_stream_has_no_second_baseline_and_a_failed_batch_leaves_the_cursor(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), n, rng.randrange(max(0, n - 3), n + 1), n // 15, float(rng.randrange(n, n + 9)), 2) for n in range(60)]
    of = lambda part: spark.createDataFrame(part, SCHEMA)
    first, seen, broken = rows[:20], [], [True]

    def keep(batch, number):
        got = batch.collect()
        if number == 1 and broken:
            broken.clear()
            raise OSError("lost")
        seen.extend(got)

    for part in (rows[20:40], rows[40:]):
        of(part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        for _ in range(2):  # the second start reads what the first one lost, or nothing
            deltas = normalize_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), delta.cursors(of(first)))
            try:
                runs.run_available(spark, deltas.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")))
            except StreamingQueryException:
                pass
    columns = ("series", "time_ms", "value", "delta", "rule")
    want = [tuple(r[c] for c in columns) for r in delta.normalize(of(rows)).where("arrival >= 20").collect()]
    assert not broken and sorted(tuple(r[c] for c in columns) for r in seen) == sorted(want)


def test_counters_of_a_stream_equal_the_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(call("use" if n % 2 else "result", f"t{n}", n) for n in range(20)) + '{"broken\n[1\n')
    listener = counters.StreamCounters()
    spark.streams.addListener(listener)
    try:
        decoded = counters.observed(transcript.decode(append_jsonl.follow(spark, str(tmp_path / "in"), str(tmp_path / "ck")).withColumnRenamed("offset", "pos")), "lines", counters.of_transcripts())
        runs.run_available(spark, decoded.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")))
        for _ in range(100):
            if listener.totals:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    kinds = {r["kind"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("kind").count().collect()}
    assert listener.totals == {("lines", "received"): 22, ("lines", "malformed"): 2, ("lines", "accepted"): 20} and kinds == {"session": 20, "malformed": 2, "use": 10, "result": 10}

