import json

import pytest
from pyspark.sql import functions as F

from sessionlens.plans import export, sessions
from sessionlens.sources.adapter import Telemetry

SF = "/root/testdata/sf0.001"


def test_documents_hold_all_fields(spark):
    t = Telemetry.of(spark, SF)
    documents = {r["id"]: json.loads(r["document"]) for r in export.export(t).collect()}
    request = {"ts_ms", "id", "model", "input_tokens", "output_tokens", "cache_read", "cache_creation", "cost_usd", "duration_ms", "is_error", "status_code"}
    result = {"ts_ms", "id", "tool_name", "success", "duration_ms", "bash_command", "mcp_server"}
    session = {"id", "first_seen", "last_seen", "app_version", "model_set", "user_email", "org_id", "token_source", "has_events"}
    requests = [r for d in documents.values() for r in d["api_requests"]]
    results = [r for d in documents.values() for r in d["tool_results"]]
    assert requests and results and all(set(r) == request for r in requests) and all(set(r) == result for r in results)
    assert all(set(d["session"]) == session and d["session"]["has_events"] == any(d[c] for c in export.CHILDREN) for d in documents.values())
    costs = t.api_requests.agg(F.sum("cost_usd")).first()[0]
    assert abs(sum(r["cost_usd"] for r in requests) - costs) < 1e-6


def test_one_session_or_not_found(spark):
    t = Telemetry.of(spark, SF)
    name = t.sessions.orderBy("id").first()["id"]
    want = export.export(t).where(F.col("id") == name).first()["document"]
    assert json.loads(export.export_one(t, name)) == json.loads(want)
    with pytest.raises(sessions.NotFound) as raised:
        export.export_one(t, "nobody")
    assert json.loads(str(raised.value)) == {"error": {"code": "not_found", "message": "session not found"}}
