"""Deltas, merges, pairing, keys, prices, indent."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import formats, keys, pricing
from sessionlens.operators import axis, delta, merge, pairing
from sessionlens.plans import timeline


def machine(points):
    out, last = [], None
    for seq, t, start, value, kind in points:
        if kind == 1:
            out.append((seq, value))
        elif last is None:
            out.append((seq, 0.0))
        elif t < last[0]:
            continue
        elif start != last[1] or value < last[2]:
            out.append((seq, value))
        else:
            out.append((seq, value - last[2]))
        last = (t, start, value)
    return out


@pytest.mark.parametrize("kinds", [(2,), (0, 2), (1,), (1, 2)])
def test_delta_equals_the_state_machine(spark, kinds):
    rng = random.Random(sum(kinds))
    rows, want = [], {}
    for s in range(25):
        points = [(n, rng.randint(0, 9), rng.choice([0, 0, 0, 1]), float(rng.randint(0, 20)), rng.choice(kinds)) for n in range(rng.randint(1, 12))]
        rows += [(f"s{s}", *p) for p in points]
        want[f"s{s}"] = machine(points)
    df = spark.createDataFrame(rows, "series string, arrival int, time_ms bigint, start_ms bigint, value double, temporality int")
    got = {}
    for r in delta.normalize_mixed(df).orderBy("series", "arrival").collect():
        got.setdefault(r["series"], []).append((r["arrival"], r["delta"]))
    assert got == want


def test_cumulative_and_delta_encodings_add_up_alike(spark):
    values = [5.0, 8.0, 8.0, 20.0]
    cumulative = spark.createDataFrame([("c", n, n, 0, v) for n, v in enumerate(values)], "series string, arrival int, time_ms int, start_ms int, value double")
    assert delta.normalize(cumulative).agg(F.sum("delta")).first()[0] == values[-1] - values[0]


def requests(spark, rows):
    return spark.createDataFrame(rows, "dedup_key string, arrival_seq int, session_id string, cost_usd double, cost_source string")


def test_cost_authority(spark):
    rows = [("a", 1, "s1", 0.2, "jsonl-estimate"), ("a", 2, "s2", 0.5, "otlp"), ("a", 3, "s3", 0.9, "otlp"), ("b", 1, "s", 1.0, None), ("b", 2, "s", 2.0, "jsonl-estimate")]
    got = {r["dedup_key"]: (r["session_id"], r["cost_usd"]) for r in merge.cost_authority(requests(spark, rows)).collect()}
    assert got == {"a": ("s1", 0.5), "b": ("s", 1.0)}
    twice = merge.cost_authority(requests(spark, rows + rows)).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, merge.cost_authority(requests(spark, rows)).collect()))


def test_authority_equals_one_by_one_upserts(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randint(0, 9)}", n, f"s{n}", float(n), rng.choice(["otlp", "jsonl-estimate"])) for n in range(80)]
    want = {}
    for key, _, session, cost, source in rows:
        held = want.get(key)
        if held is None:
            want[key] = [session, cost, source]
        elif source == "otlp" and held[2] != "otlp":
            held[1:] = [cost, source]
    got = {r["dedup_key"]: [r["session_id"], r["cost_usd"], r["cost_source"]] for r in merge.cost_authority(requests(spark, rows)).collect()}
    assert got == want


def test_insert_ignore_with_target(spark):
    rows = requests(spark, [("a", 2, "s", 1.0, ""), ("a", 1, "t", 2.0, ""), ("b", 3, "u", 3.0, "")])
    target = requests(spark, [("b", 0, "x", 0.0, "")])
    assert [(r["dedup_key"], r["session_id"]) for r in merge.insert_ignore(rows, ["dedup_key"], target=target).collect()] == [("a", "t")]


def test_sessions_merge_and_missing_ones(spark):
    rows = spark.createDataFrame([("s", 5, 9, "v1", False, 1), ("s", 3, 7, "", True, 2)], "id string, first_seen bigint, last_seen bigint, app_version string, has_events boolean, arrival_seq int")
    merged = merge.merge_sessions(rows)
    assert tuple(merged.first()) == ("s", 3, 9, "v1", True)
    child = spark.createDataFrame([("t", 4), (None, 6), ("s", 1)], "session_id string, ts_ms bigint")
    assert {r["id"] for r in merge.with_missing_sessions(merged, child).collect()} == {"s", "t", ""}


def test_retention(spark):
    s = spark.createDataFrame([("a", 100), ("b", 200), ("c", 200), ("d", 10)], "id string, last_seen bigint")
    assert {r["id"] for r in merge.retained_sessions(s, 200, 150, 2).collect()} == {"b", "c"}
    state, points = spark.createDataFrame([("x",), ("y",)], "series_key string"), spark.createDataFrame([("x",)], "series_key string")
    assert [r[0] for r in merge.orphan_series(state, points).collect()] == ["y"]


def test_retention_rules_are_off_at_zero(spark):
    s = spark.createDataFrame([("a", 100), ("b", 200)], "id string, last_seen bigint")
    assert merge.retained_sessions(s, 1000, 0, 0).count() == 2 and merge.retained_sessions(s, 1000, 850, 0).count() == 1 and merge.retained_sessions(s, 1000, 0, 1).count() == 1


def test_prompt_length_is_a_json_number(spark):
    values = ['{"prompt_length":12,"prompt":"x"}', '{"prompt_length":"12"}', '{"prompt_length":3.9}', '{"prompt_length":true}', "{}", "no json", None]
    df = spark.createDataFrame([(v,) for v in values], "attrs_json string")
    assert [r["prompt_length"] for r in timeline.prompt_fields(df).collect()] == [12, None, 3, None, None, None, None]


def test_single_line_is_cut_by_bytes(spark):
    values = ["a\n\tb  c", "x" * 81, "é" * 41, "é" * 40, "  "]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(keys.single_line(F.col("t"))).collect()]
    assert got[0] == "a b c" and got[1] == "x" * 77 + "..." and got[3] == "é" * 40 and got[4] == ""
    assert got[2].startswith("é" * 38) and got[2].endswith("...") and len(got[2]) == 42


def test_pairing(spark):
    uses = spark.createDataFrame([("f", "i", 1, "Bash"), ("f", "i", 4, "Edit"), ("f", "j", 2, "Read")], "file string, tool_use_id string, pos int, tool string")
    results = spark.createDataFrame([("f", "i", 0, "r0"), ("f", "i", 2, "r2"), ("f", "i", 3, "r3"), ("f", "i", 5, "r5"), ("f", "z", 6, "r6")], "file string, tool_use_id string, pos int, result string")
    got = {r["result"]: r["tool"] for r in pairing.pair(uses, results).collect()}
    assert got == {"r0": None, "r2": "Bash", "r3": None, "r5": "Edit", "r6": None}
    nameless = spark.createDataFrame([("f", None, 1, "Bash"), ("f", "", 4, "Edit")], "file string, tool_use_id string, pos int, tool string")
    replies = spark.createDataFrame([("f", None, 2, "r0"), ("f", "", 5, "r2")], "file string, tool_use_id string, pos int, result string")
    assert {r["result"]: r["tool"] for r in pairing.pair(nameless, replies).collect()} == {"r0": None, "r2": None}


def test_axis_takes_one_source_only(spark):
    api = spark.createDataFrame([("e", 1.0, 10, 5, 0, 0)], "session_id string, cost_usd double, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_creation bigint")
    points = spark.createDataFrame([("e", "cost.usage", "m", 9.0), ("m", "cost.usage", "x", 2.5), ("m", "token.usage", "input", 7.6), ("m", "token.usage", "input", 0.6), ("p", "other", "", 1.0)], "session_id string, name string, attr_key string, value_delta double")
    got = {r["session_id"]: (r["token_source"], r["cost_usd"], r["input_tokens"]) for r in axis.session_totals(api, points).collect()}
    assert got == {"e": ("events", 1.0, 10), "m": ("metrics", 2.5, 8)}


def test_keys(spark):
    row = spark.createDataFrame([("ab", "c", "a", "bc")], "a string, b string, c string, d string")
    one, two, null = row.select(keys.dedup_key(F.col("a"), F.col("b")), keys.dedup_key(F.col("c"), F.col("d")), keys.dedup_key(F.col("a"), F.lit(None))).first()
    assert one == hashlib.sha256(b"ab\0c").hexdigest()[:16] and one != two and null == hashlib.sha256(b"ab\0").hexdigest()[:16]
    text = spark.createDataFrame([("/a/b/",), (r"C:\x\y",), ("C:",), (".",), ("/",), (None,)], "p string")
    assert [r[0] for r in text.select(keys.repo_of(F.col("p"))).collect()] == ["b", "y", "", "", "", ""]
    names = spark.createDataFrame([("mcp__srv__run",), ("mcp__solo",), ("Bash",)], "t string")
    assert [r[0] for r in names.select(keys.mcp_server(F.col("t"))).collect()] == ["srv", "solo", ""]
    value = spark.createDataFrame([("12",), ("3.9",), ("x",), (None,)], "v string")
    assert [r[0] for r in value.select(keys.to_long(F.col("v"))).collect()] == [12, 3, 0, 0]
    ns = spark.createDataFrame([(1767225600123999999,)], "n bigint")
    assert ns.select(keys.ns_to_ms(F.col("n"))).first()[0] == 1767225600123


def test_prices(spark):
    row = spark.createDataFrame([("claude-opus-4", 6, 29, 48622, 8228)], "m string, i bigint, o bigint, r bigint, w bigint")
    got = row.select(pricing.estimated_cost(*map(F.col, "miorw"))).first()[0]
    assert got == pytest.approx((6 * 15 + 29 * 75 + 48622 * 1.5 + 8228 * 18.75) / 1e6)
    saved = spark.createDataFrame([("haiku", 1_000_000), ("opus", 500_000), ("other", 5)], "m string, n bigint").agg(F.sum(pricing.cache_saved(F.col("m"), F.col("n")))).first()[0]
    assert saved == pytest.approx(7.65)


def test_indent_equals_a_fold(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for s in range(30):
        api, after_tool = 0, False
        for n in range(rng.randint(1, 25)):
            seq = rng.choice([0, 1, 1, 2, 3])
            if seq == 0:
                level = api = 0
            elif seq == 1:
                level = api = min(2, api + after_tool)
            else:
                level = min(2, api + 1)
            after_tool = seq >= 2
            rows.append((f"s{s}", n, seq, n))
            want[f"s{s}", n] = level
    df = spark.createDataFrame(rows, "session_id string, ts_ms int, seq int, id int")
    assert {(r["session_id"], r["id"]): r["level"] for r in timeline.with_indent(df).collect()} == want


def test_formats():
    assert (formats.parse_duration("90d"), formats.parse_duration("1h30m"), formats.parse_size("16MB"), formats.parse_size("32 KiB")) == (7776000, 5400, 16 << 20, 32768)
    assert formats.since_of("all", 5) == 0 and formats.cost(0.125) == "$0.12" and formats.cost(-1) == "$0.00"
    assert [formats.tokens(n) for n in (-5, 999, 1500, 128_000, 999_949, 2_000_000)] == ["0", "999", "1.5K", "128K", "999.9K", "2M"]
    assert [formats.duration(n) for n in (250, 1500, 61_500, 3_720_000)] == ["250ms", "1.5s", "1m 1s", "62m 0s"]
    assert [formats.percent(x) for x in (0.125, -1.0, 0.714)] == ["13%", "0%", "71%"] and formats.grouped(1234567) == "1,234,567"
    assert formats.time_range(1767225600000, 1767229200000) == "00:00–01:00 (60m 0s)" and formats.time_range(60_000, 0) == "00:01–00:00 (0ms)" and formats.or_dash("") == "-"
    with pytest.raises(ValueError):
        formats.parse_duration("soon")
