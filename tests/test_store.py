"""One commit over all tables, buckets that split, deletes and retention."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import merge
from sessionlens.streaming.store import Store, Table

FIRST = {"a": Table(("k",), lambda rows: merge.insert_ignore(rows, ["k"], "seq")), "b": Table(("k",), lambda rows: merge.insert_ignore(rows, ["k"], "seq"))}


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, seq bigint")


def held(store, name="a"):
    table = store.read(name)
    return None if table is None else {r["k"]: r["seq"] for r in table.collect()}


def test_batches_merge_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", FIRST)
    assert store.read("a") is None and store.batch() == -1
    for _ in range(2):
        store.write(0, {"a": rows(spark, ("x", 1), ("y", 2)), "b": rows(spark, ("x", 9))})
    store.write(1, {"a": rows(spark, ("x", 3), ("z", 4))})
    assert held(store) == {"x": 1, "y": 2, "z": 4} and held(store, "b") == {"x": 9} and store.batch() == 1


def test_a_crash_between_two_tables_leaves_the_last_whole_state(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", FIRST)
    store.write(0, {"a": rows(spark, ("x", 1)), "b": rows(spark, ("x", 1))})

    def broken(held):
        raise OSError("lost")

    failing = Store(spark, f"file://{tmp_path}", {"a": FIRST["a"], "b": Table(("k",), broken)})
    with pytest.raises(OSError):
        failing.write(1, {"a": rows(spark, ("y", 2)), "b": rows(spark, ("y", 2))})
    (tmp_path / "commits" / ".2.tmp").write_text("{")  # a commit that was begun
    again = Store(spark, f"file://{tmp_path}", FIRST)
    assert held(again) == held(again, "b") == {"x": 1}
    again.write(1, {"a": rows(spark, ("y", 2)), "b": rows(spark, ("y", 2))})
    assert held(again) == held(again, "b") == {"x": 1, "y": 2}
    assert len(list((tmp_path / "commits").glob("[0-9]*.json"))) == 2


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", {"a": FIRST["a"]}, bucket_rows=50)
    want = {}
    for batch in range(4):
        new = [(f"k{batch}-{n}", batch * 1000 + n) for n in range(400)]
        store.write(batch, {"a": rows(spark, *new)})
        want |= dict(new)
        assert held(store) == want
    for batch in range(4, 7):  # the table's 1,600 rows or more stay where they are
        before = store.written_rows
        store.write(batch, {"a": rows(spark, (f"late{batch}", batch), ("k0-7", 10**9))})
        want[f"late{batch}"] = batch
        assert store.written_rows - before <= 2 * 110
    assert held(store) == want
    buckets = store._state()[1]["tables"]["a"]
    assert sum(1 / (1 << b["depth"]) for b in buckets) == 1 and len(buckets) > 16 and sum(b["rows"] for b in buckets) == len(want)


def session(name, last, seq):
    return (name, 1, last, seq)


def test_retention_cascades_in_one_commit(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", bucket_rows=5)
    rng = random.Random(1)
    sessions = [session(f"s{k}", 1000 + k, k) for k in range(20)]
    calls = [(f"d{k}", f"s{rng.randrange(20)}", k, "web", 1.0, "otlp") for k in range(100)]
    points = [(f"series{k % 30}", k, k, f"s{k % 30 % 20}", k) for k in range(90)]
    cursors = [(f"series{k}", float(k), k) for k in range(35)]
    store.write(0, {
        "sessions": spark.createDataFrame(sessions, "id string, first_seen bigint, last_seen bigint, arrival_seq bigint"),
        "api_requests": spark.createDataFrame(calls, "dedup_key string, session_id string, arrival_seq bigint, model string, cost_usd double, cost_source string"),
        "metric_points": spark.createDataFrame(points, "series_key string, start_ns bigint, time_ns bigint, session_id string, arrival_seq bigint"),
        "series_state": spark.createDataFrame(cursors, "series_key string, last_value double, arrival_seq bigint"),
    })
    store.retain(1019, 15, 10)  # of the 16 young ones the 10 latest
    kept = {f"s{k}" for k in range(10, 20)}
    assert {r["id"] for r in store.read("sessions").collect()} == kept
    assert {r["dedup_key"] for r in store.read("api_requests").collect()} == {c[0] for c in calls if c[1] in kept}
    left = {(p[0], p[1]) for p in points if p[3] in kept}
    assert {(r["series_key"], r["start_ns"]) for r in store.read("metric_points").collect()} == left
    assert {r["series_key"] for r in store.read("series_state").collect()} == {s for s, _ in left}
    number = store._state()[0]
    store.retain(1019, 15, 10)  # nothing more to delete
    store.retain(0, 0, 0)  # both rules off
    assert store._state()[0] == number == 2
    store.write(1, {"sessions": spark.createDataFrame([session("s1", 5000, 99)], "id string, first_seen bigint, last_seen bigint, arrival_seq bigint")})
    assert "s1" in {r["id"] for r in store.read("sessions").collect()}


def test_authority_over_batches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    schema = "dedup_key string, session_id string, arrival_seq bigint, model string, cost_usd double, cost_source string"
    for batch, (cost, source) in enumerate([(1.0, "jsonl-estimate"), (2.0, "otlp"), (3.0, "otlp"), (4.0, "jsonl-estimate")]):
        store.write(batch, {"api_requests": spark.createDataFrame([("k", f"s{batch}", batch, "m", cost, source)], schema)})
    assert tuple(store.read("api_requests").select("session_id", "cost_usd", "cost_source").first()) == ("s0", 2.0, "otlp")


def test_deletes_of_all_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", FIRST, bucket_rows=2)
    store.write(0, {"a": rows(spark, *((f"k{n}", n) for n in range(9)))})
    store.delete({"a": store.read("a").select("k"), "b": rows(spark, ("x", 1)).select("k")})
    assert held(store) == {} and store.read("a").columns == ["k", "seq"]
    store.write(1, {"a": rows(spark, ("k1", 7)).where(F.lit(True))})
    assert held(store) == {"k1": 7}
