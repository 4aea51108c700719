"""Transcripts, OTLP/JSON and the append-aware source."""

import hashlib
import json
import random

from sessionlens.plans import cost, sessions
from sessionlens.sources import append_jsonl, collect, otlp, transcript
from sessionlens.sources.append_jsonl import _Reader, _StreamReader


def line(**more):
    return json.dumps({"uuid": "u", "timestamp": "2026-01-01T00:00:01.500Z", "sessionId": "s", "cwd": "/w/repo", "gitBranch": "main", "version": "1"} | more)


def assistant(content, model="claude-opus-4", **usage):
    return line(type="assistant", message={"role": "assistant", "model": model, "usage": usage or {"input_tokens": 6, "output_tokens": 29}, "content": content})


def test_transcript(spark, tmp_path):
    use = {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}
    other = {"type": "tool_use", "id": "t2", "name": "mcp__srv__run", "input": {}}
    results = [{"type": "tool_result", "tool_use_id": "t1", "is_error": True}, {"type": "tool_result", "tool_use_id": "t2"}, {"type": "tool_result", "tool_use_id": "t9"}]
    lines = [assistant([use, other]), line(type="user", message={"role": "user", "content": results}), line(type="user", message={"role": "user", "content": "héllo"}), line(type="user", message={"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": " "}]}), "{broken", ""]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "A.JSONL").write_text("\n".join(lines))
    (tmp_path / "no.txt").write_text("{}")
    decoded = transcript.decode(transcript.read_lines(spark, str(tmp_path)))
    assert tuple(transcript.stats(decoded).first()) == (5, 4, 1)
    (call,) = transcript.api_requests(decoded).collect()
    assert (call["input_tokens"], call["ts_ms"], call["cost_source"]) == (6, 1767225601500, "jsonl-estimate")
    found = {r["tool_use_id"]: (r["tool_name"], r["success"], r["bash_command"], r["mcp_server"]) for r in transcript.tool_results(decoded).collect()}
    assert found == {"t1": ("Bash", False, "ls", ""), "t2": ("mcp__srv__run", True, "", "srv"), "t9": ("", True, "", "")}
    prompts = sorted(json.loads(r["attrs_json"])["prompt_length"] for r in transcript.user_prompts(decoded).collect())
    assert prompts == [1, 6]
    assert all("prompt\"" not in r["attrs_json"] for r in transcript.user_prompts(decoded, False).collect())
    (session,) = transcript.sessions(decoded).collect()
    assert (session["repo"], session["model_set"], session["git_branch"]) == ("repo", "claude-opus-4", "main")


def attrs(**values):
    return [{"key": k.replace("__", "."), "value": {"stringValue": v} if isinstance(v, str) else {"doubleValue": v}} for k, v in values.items()]


def test_otlp(spark, tmp_path):
    point = lambda **more: {"timeUnixNano": "1767225600000000000", "startTimeUnixNano": "5", "attributes": attrs(type="input"), **more}
    metrics = {"resourceMetrics": [{"resource": {"attributes": attrs(session__id="s")}, "scopeMetrics": [{"metrics": [
        {"name": "token.usage", "sum": {"aggregationTemporality": 2, "dataPoints": [point(asInt="7"), point()]}}, {"name": "g", "gauge": {"dataPoints": [point(asDouble=1.5)]}}, {"name": "h", "histogram": {"dataPoints": [{"count": "1"}]}}]}]}]}
    (tmp_path / "m.json").write_text(json.dumps(metrics))
    good, bad = otlp.metric_points(otlp.read(spark, str(tmp_path / "m.json"), otlp.METRICS))
    assert sorted((r["name"], r["value"], r["session_id"], r["attr_key"]) for r in good.collect()) == [("g", 1.5, "s", "input"), ("token.usage", 7.0, "s", "input")]
    assert sorted(map(tuple, bad.collect())) == [("h", "unsupported shape"), ("token.usage", "no value")]
    record = lambda name, **a: {"timeUnixNano": "1767225600000000000", "eventName": name, "attributes": attrs(**a)}
    logs = {"resourceLogs": [{"resource": {"attributes": attrs(session_id="s")}, "scopeLogs": [{"logRecords": [
        record("claude_code.api_request", model="m", input_tokens="12", cost_usd=0.5), record("api_error", status_code="529"), record("tool_decision", tool_name="Bash", decision="accept", source="config"),
        record("tool_result", tool_name="Bash", success="true", tool_parameters='{"full_command":"ls"}'), record("user_prompt", prompt="secret", prompt_length="6")]}]}]}
    (tmp_path / "l.json").write_text(json.dumps(logs))
    records = otlp.log_records(otlp.read(spark, str(tmp_path / "l.json"), otlp.LOGS))
    calls = {r["is_error"]: r for r in otlp.api_requests(records).collect()}
    assert calls[False]["input_tokens"] == 12 and calls[False]["cost_usd"] == 0.5 and calls[True]["status_code"] == 529
    assert otlp.tool_decisions(records).first()["decision"] == "accept"
    assert otlp.tool_results(records).first()["bash_command"] == "ls"
    assert json.loads(otlp.generic_events(records, False).first()["attrs_json"])["prompt"] == "[redacted]"
    traces = {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [{"traceId": "AB", "spanId": "01", "name": "n", "status": {"code": 2}}, {"name": "none"}]}]}]}
    (tmp_path / "t.json").write_text(json.dumps(traces))
    (span,) = otlp.spans(otlp.read(spark, str(tmp_path / "t.json"), otlp.TRACES)).collect()
    assert (span["trace_id"], span["status"]) == ("ab", "error")


def export(*records):
    return {"resourceLogs": [{"resource": {"attributes": attrs(session__id="s", service__version="2")}, "scopeLogs": [{"logRecords": list(records)}]}]}


def record(name, **a):
    return {"timeUnixNano": "1767225601500000000", "eventName": f"claude_code.{name}", "attributes": attrs(**a)}


def test_prompts_that_look_like_lists(spark, tmp_path):
    user = lambda content, n: line(type="user", uuid=f"u{n}", message={"role": "user", "content": content})
    (tmp_path / "a.jsonl").write_text("\n".join([user("[draft] please fix", 1), user("[1, 2]", 2), user([{"type": "text", "text": "yes"}], 3), user([{"type": "text", "text": " "}], 4), user("", 5)]))
    decoded = transcript.decode(transcript.read_lines(spark, str(tmp_path)))
    assert sorted(json.loads(r["attrs_json"])["prompt"] for r in transcript.user_prompts(decoded).collect()) == ["[1, 2]", "[draft] please fix", "yes"]


def test_uses_without_an_id_are_skipped(spark, tmp_path):
    results = [{"type": "tool_result"}, {"type": "tool_result", "tool_use_id": ""}, {"type": "tool_result", "tool_use_id": "t1"}]
    uses = [{"type": "tool_use", "name": "Bash", "input": {"command": "rm"}}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}]
    (tmp_path / "a.jsonl").write_text("\n".join([assistant(uses), line(type="user", timestamp="?", message={"role": "user", "content": results})]))
    decoded = transcript.decode(transcript.read_lines(spark, str(tmp_path)))
    rows = sorted((r["tool_name"], r["bash_command"], r["ts_ms"]) for r in transcript.tool_results(decoded).collect())
    assert rows == [("", "", 0), ("", "", 0), ("Bash", "ls", 1767225601500)]
    assert sorted(r["bash_command"] for r in transcript.tool_results(decoded, False).collect()) == ["", "", "[redacted]"]


def test_second_names_masks_and_attributes(spark, tmp_path):
    records = [record("api_request", model="m", cost=0.25, duration=7.0, http__status_code="200"), record("tool_result", tool="Bash", success="true", duration="9", tool_parameters='{"command":"rm x","server":"srv"}', full_command="rm x"), record("tool_decision", tool="Edit", decision="accept", source="hook")]
    records[0]["attributes"].append({"key": "tags", "value": {"arrayValue": {"values": [{"stringValue": "a"}]}}})
    (tmp_path / "l.json").write_text(json.dumps(export(*records)))
    r = otlp.log_records(otlp.read(spark, str(tmp_path / "l.json"), otlp.LOGS))
    call, result, decision = otlp.api_requests(r).first(), otlp.tool_results(r, False).first(), otlp.tool_decisions(r).first()
    assert (call["cost_usd"], call["duration_ms"], call["status_code"]) == (0.25, 7, 200) and json.loads(call["attrs_json"])["tags"] == ["a"]
    assert (result["tool_name"], result["duration_ms"], result["bash_command"], result["mcp_server"]) == ("Bash", 9, "[redacted]", "srv")
    assert "rm x" not in result["attrs_json"] and decision["tool_name"] == "Edit"
    assert otlp.tool_results(r).first()["bash_command"] == "rm x"


def test_events_are_keyed_by_the_time_as_it_came(spark, tmp_path):
    late = {k: v for k, v in record("other", x="1").items() if k != "timeUnixNano"} | {"observedTimeUnixNano": "1767225601500000000"}
    (tmp_path / "l.json").write_text(json.dumps(export(late)))
    event = otlp.generic_events(otlp.log_records(otlp.read(spark, str(tmp_path / "l.json"), otlp.LOGS))).first()
    assert event["ts_ms"] == 1767225601500 and event["dedup_key"] == hashlib.sha256(b"s\0other\x000\0").hexdigest()[:16]


def test_folders_to_plans(spark, tmp_path):
    """One request in both sources: one row, at the export's cost; a metric-only session beside it."""
    use = {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_text("\n".join([assistant([use]), line(type="user", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1"}]})]))
    (tmp_path / "l.json").write_text(json.dumps(export(record("api_request", model="claude-opus-4", input_tokens="6", output_tokens="29", cost_usd=0.5), record("user_prompt", prompt="hi", prompt_length="2"), record("tool_decision", tool_name="Bash", decision="accept", source="hook"))))
    point = lambda value, at: {"timeUnixNano": str(1767225600000000000 + at), "startTimeUnixNano": "5", "asDouble": value, "attributes": attrs(session__id="m", model="claude-haiku-4")}
    metrics = {"resourceMetrics": [{"resource": {"attributes": []}, "scopeMetrics": [{"metrics": [{"name": "cost.usage", "sum": {"aggregationTemporality": 2, "dataPoints": [point(1.0, 0), point(1.5, 10**9), point(1.5, 10**9), point(0.25, 2 * 10**9)]}}]}]}]}
    (tmp_path / "m.json").write_text(json.dumps(metrics))
    t = collect.from_folders(spark, str(tmp_path / "t"), str(tmp_path / "m.json"), str(tmp_path / "l.json"))
    (call,) = t.api_requests.collect()
    assert (call["cost_usd"], call["cost_source"], call["session_id"]) == (0.5, "otlp", "s")
    rows = {r["id"]: r for r in sessions.session_list(t).collect()}
    assert (rows["s"]["token_source"], rows["s"]["cost_usd"], rows["s"]["tool_accept"], rows["s"]["model_set"]) == ("events", 0.5, 1, "claude-opus-4")
    # baseline 0, growth 0.5 once, reset in full
    assert (rows["m"]["token_source"], rows["m"]["cost_usd"]) == ("metrics", 0.75)
    assert {r["model"]: r["cost_usd"] for r in cost.cost_by_model(t).collect()} == {"claude-opus-4": 0.5, "claude-haiku-4": 0.75}
    about = {r["id"]: r for r in t.sessions.collect()}
    assert (about["s"]["app_version"], about["s"]["has_events"], about["s"]["repo"], about["m"]["has_events"]) == ("2", True, "repo", False)
    alone = collect.from_folders(spark, str(tmp_path / "t"))
    assert alone.api_requests.first()["cost_source"] == "jsonl-estimate" and sessions.session_list(alone).count() == 1


def test_ranges_own_whole_lines(tmp_path):
    """However a file is cut, its lines come once each, in order, with their offsets."""
    rng = random.Random(4)
    lines = [rng.choice(["", "x", "é" * rng.randrange(9), "y" * rng.randrange(40)]) for _ in range(60)]
    for unfinished in ("", "tail"):
        data = "".join(x + "\n" for x in lines).encode() + unfinished.encode()
        (tmp_path / "a.JSONL").write_bytes(data)
        want, at = [], 0
        for x in lines + [unfinished] * bool(unfinished):
            want.append((at, x))
            at += len(x.encode()) + 1
        for most in (1, 3, 7, 64, 10**6):
            reader = _Reader(str(tmp_path), most)
            got = [(o, v) for part in reader.partitions() for batch in reader.read(part) for o, v in zip(batch["offset"].to_pylist(), batch["value"].to_pylist(), strict=True)]
            assert got == want


def test_one_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"uuid": "{k}"}}\n' for k in range(500)))
    rows = transcript.read_lines(spark, str(tmp_path), range_bytes=1000)
    assert rows.rdd.getNumPartitions() >= 7
    assert [json.loads(r["value"])["uuid"] for r in rows.orderBy("pos").collect()] == [str(k) for k in range(500)]
    whole = transcript.read_lines(spark, str(tmp_path))
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in whole.collect()}


def streamed(folder, starts, **options):
    """What a reader plans and reads, trigger by trigger; starts: what happens to the files before each."""
    reader, start, out = _StreamReader(str(folder), options.get("most", 4), options.get("trigger", 0), options.get("progress")), {}, []
    start = reader.initialOffset()
    for change in starts:
        change()
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        out.append([v for part in parts for batch in reader.read(part) for v in batch["value"].to_pylist()])
        start = end
    return out


def test_growing_files(tmp_path):
    path = tmp_path / "a.jsonl"
    add = lambda text: lambda: path.open("a").write(text)
    got = streamed(tmp_path, [lambda: None, add("1\n2\npart"), lambda: None, add("ial\n3\n"), lambda: path.write_text("x\n"), add("yy\n"), path.unlink])
    assert got == [[], ["1", "2"], [], ["partial", "3"], ["x"], ["yy"], []]


def test_bytes_a_trigger(tmp_path):
    for name, n in (("a", 40), ("b", 4), ("c", 12)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{k:02}\n" for k in range(n)))
    seen = streamed(tmp_path, [lambda: None] * 8, trigger=32)
    assert [v for part in seen for v in part if v[0] == "a"] == [f"a{k:02}" for k in range(40)]
    assert sum(map(len, seen)) == 56 and all(sum(len(v) + 1 for v in part) <= 32 + 3 * 4 for part in seen)


def test_append_stream(spark, tmp_path):
    """Starts on one checkpoint: nothing twice, nothing lost; a bound on bytes holds from the first trigger after a restart."""
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir()
    (folder / "a.jsonl").write_text("1\n2\n3")
    for more, want in (("", ["1", "2"]), ("4\n", ["1", "2", "34"]), ("5\n6\n7\n", ["1", "2", "34", "5", "6"]), ("", ["1", "2", "34", "5", "6", "7"])):
        with (folder / "a.jsonl").open("a") as f:
            f.write(more)
        stream = append_jsonl.follow(spark, str(folder), checkpoint, 5, 2)
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == sorted(want)


def test_each_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(assistant([{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}]) + "\n")
    decoded = transcript.decode(transcript.read_lines(spark, str(tmp_path)))
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 2 and plan.count("RelationV2") == 1  # the line, and its content
    t = collect.from_folders(spark, str(tmp_path))
    plan = t.sessions._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "parse_json" not in plan


def stored(spark, tmp_path, attributes):
    """attrs_json of a generic event with these attributes."""
    (tmp_path / "l.json").write_text(json.dumps(export({"timeUnixNano": "5", "eventName": "e", "attributes": attributes})))
    return otlp.generic_events(otlp.log_records(otlp.read(spark, str(tmp_path / "l.json"), otlp.LOGS))).first()["attrs_json"]


def wire(value):
    """A plain value in the wire form."""
    if isinstance(value, list):
        return {"arrayValue": {"values": [wire(v) for v in value]}}
    if isinstance(value, dict):
        return {"kvlistValue": {"values": [{"key": k, "value": wire(v)} for k, v in value.items()]}}
    kinds = {bool: "boolValue", int: "intValue", float: "doubleValue", str: "stringValue"}
    return {} if value is None else {kinds[type(value)]: str(value) if type(value) is int else value}


def test_nested_attributes(spark, tmp_path):
    deep = [1]
    for _ in range(9):
        deep = [deep]
    marked = f"{otlp.TRUNCATED}:depth_exceeded"
    for _ in range(otlp.MOST_DEPTH):
        marked = [marked]
    plain = {"s": 'a "q" \\ \n é', "n": 7, "f": 0.5, "b": True, "none": None, "list": [1, "x", [], {"z": [None, 2], "a": {}}], "map": {"k": [False]}, "deep": deep}
    rows = [{"key": k, "value": wire(v)} for k, v in plain.items()]
    rows += [{"key": "", "value": wire(1)}, {"key": "n", "value": wire(8)}, {"key": "bytes", "value": {"bytesValue": "aGk="}}, {"key": "twice", "value": {"kvlistValue": {"values": [{"key": "k", "value": wire(1)}, {"key": "k", "value": wire([2])}, {"key": "", "value": wire(3)}]}}}]
    assert json.loads(stored(spark, tmp_path, rows)) == plain | {"deep": marked, "n": 8, "bytes": "hi", "twice": {"k": [2]}}


def test_bounds_of_attributes(spark, tmp_path):
    many = json.loads(stored(spark, tmp_path, [{"key": f"k{n:03}", "value": wire(n)} for n in range(300)]))
    assert many == {f"k{n:03}": n for n in range(256)} | {otlp.TRUNCATED: "attribute_count_exceeded"}
    text = stored(spark, tmp_path, [{"key": k, "value": wire(v)} for k, v in (("a", "x" * 40_000), ("b", "y" * 40_000), ("c", 1))])
    assert len(text) <= otlp.MOST_BYTES and json.loads(text) == {"a": "x" * 40_000, otlp.TRUNCATED: "byte_size_exceeded"}
    assert stored(spark, tmp_path, []) == "{}"

