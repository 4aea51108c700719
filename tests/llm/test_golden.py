import datetime as dt
import random

import duckdb
import pytest

from sessionlens.llm import golden

SCHEMA = "client_id bigint, master_id bigint, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, rank int, n_stale string"
START = dt.datetime(2024, 1, 1)
BLANKS = ["", " \t\r\n\x0b\x0c"]


def brute(rows):
    """The contract, record by record."""
    text = lambda x: None if x is None or not x.strip(golden.BLANK) else x
    clusters = {}
    for client, master, source, at, name, email, city, nation, segment, balance, *_ in rows:
        trust = golden.TRUST.index(source) if source in golden.TRUST else 9
        r = {"id": client, "at": at, "trust": trust, "name": text(name), "email": text(email), "city": text(city), "nation": nation, "segment": text(segment), "balance": balance}
        clusters.setdefault(client if master is None else master, []).append(r)
    out = set()
    for cluster, own in clusters.items():
        latest = max((r["at"] for r in own if r["at"]), default=None)
        last = lambda x: (x is None, x or 0)
        text_last = lambda x: (x is None, x or "")
        recent = lambda r: (r["at"] is None, -(r["at"] - START).total_seconds() if r["at"] else 0, r["trust"], last(r["id"]), text_last(r["name"]), text_last(r["email"]), text_last(r["segment"]), last(r["balance"]), text_last(r["city"]), last(r["nation"]))
        stale = lambda r: r["at"] is None or latest - r["at"] > dt.timedelta(hours=golden.STALE_HOURS)
        trusted = lambda r: (stale(r), r["trust"], recent(r))
        first = lambda field, key: min((r for r in own if r[field] is not None), key=key, default={field: None, "id": None})
        segment, email, name = first("segment", recent), first("email", trusted), first("name", lambda r: (-len(r["name"]), trusted(r)))
        balance = first("balance", lambda r: (r["segment"] != segment["segment"], recent(r)))
        address = min(own, key=lambda r: ((r["city"] is None) + (r["nation"] is None), trusted(r)))
        cents = None if balance["balance"] is None else int((100 * balance["balance"] + 0.5) // 1)
        some = address["city"] is not None or address["nation"] is not None
        out.add((cluster, len(own), sum(map(stale, own)), name["name"], email["email"], segment["segment"], address["city"], address["nation"], cents, name["id"], email["id"], segment["id"], balance["id"], address["id"] if some else None))
    return out


def some_rows(seed, n, clusters):
    rng = random.Random(seed)
    word = lambda: rng.choice([None, *BLANKS, "a", "b ", " ü🙂", "ccc", "dddd"])
    out = []
    for k in range(n):
        at = rng.choice([None, START + dt.timedelta(hours=rng.randrange(0, 3000, 480)), START + dt.timedelta(days=60 * rng.randrange(3), microseconds=rng.randrange(2))])
        master = rng.choice([None, 1, 1, rng.randrange(clusters)])
        row = (rng.choice([k, k // 2, None]), master, rng.choice([*golden.TRUST, None, "CRM", "x"]), at, word(), word(), word(), rng.choice([None, 1, 2]), word(), rng.choice([None, 1.005, -2.5, 7.0]), 5, "x")
        out += [row] * rng.choice([1, 1, 1, 3])
    return out


def collected(rows):
    return [tuple(r) for r in rows.collect()]


@pytest.mark.parametrize("shards", [1, 64])
def test_equals_brute_force(spark, monkeypatch, shards):
    monkeypatch.setattr(golden, "SHARDS", shards)
    for seed in range(3):
        rows = some_rows(seed, 150, 40)
        got = collected(golden.golden_records(spark.createDataFrame(rows, SCHEMA)))
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_edges_of_stale(spark):
    edge = START + dt.timedelta(hours=golden.STALE_HOURS)
    rows = [(1, None, "web", edge, None, "new", None, None, None, None, 0, ""), (2, 1, "crm", START, None, "old", None, None, None, None, 0, "")]
    assert collected(golden.golden_records(spark.createDataFrame(rows, SCHEMA)))[0][2:5:2] == (0, "old")
    rows[0] = (*rows[0][:3], edge + dt.timedelta(microseconds=1), *rows[0][4:])
    assert collected(golden.golden_records(spark.createDataFrame(rows, SCHEMA)))[0][2:5:2] == (1, "new")


def test_zoned_times_and_unusual_numbers(spark):
    rows = [(1, None, "web", START, None, None, None, None, None, float("nan"), 0, ""), (2, 1, "crm", START - dt.timedelta(days=90), "x" * 40_000, None, None, None, None, float("-inf"), 0, "")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("updated_at", golden.F.col("updated_at").cast("timestamp"))
    (got,) = collected(golden.golden_records(table))
    assert got[:4] == (1, 2, 1, "x" * 40_000) and got[8] is None and got[13] is None


def test_empty(spark):
    assert golden.golden_records(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW clients AS SELECT * FROM '{sf}/clients.parquet'")
    got, want = golden.op13_golden(spark, sf), duckdb.sql(golden.ORACLE)
    assert got.columns == want.columns and set(collected(got)) == set(want.fetchall())


def test_no_broadcast_and_no_single_partition(spark):
    plan = golden.op13_golden(spark, "/root/testdata/sf0.01")._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "SinglePartition" not in plan and "Python" not in plan
