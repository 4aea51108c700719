"""Lines of text: status line, report, log."""

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import lines
from sessionlens.plans import report, sessions, timeline
from sessionlens.sources.adapter import Telemetry

SF = "/root/testdata/sf0.001"


def test_status_line():
    row = {"cost_usd": 0.4249, "input_tokens": 128_400, "output_tokens": 12_100, "cache_hit_ratio": 0.705, "tool_reject": 2, "last_tool": "Bash"}
    assert lines.status_line(row) == "$0.42 · in 128.4K/out 12.1K · cache 71% · ⊘2 reject · Bash"
    assert lines.status_line(row | {"tool_reject": 0, "last_tool": ""}) == "$0.42 · in 128.4K/out 12.1K · cache 71%"


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ({"kind": "api_request", "model": "m", "input_tokens": 6, "output_tokens": 29, "cost_usd": 0.25, "duration_ms": 1500}, "api      m in=6 out=29 cost=$0.2500 dur=1.5s"),
        ({"kind": "api_error", "model": "m", "status_code": 529}, "error    m status=529"),
        ({"kind": "tool_decision", "decision": "reject", "tool_name": "Edit", "source": "hook"}, "decision reject Edit (source=hook)"),
        ({"kind": "tool_decision", "decision": "accept", "tool_name": "Edit", "source": ""}, "decision accept Edit"),
        ({"kind": "tool_result", "tool_name": "Bash", "success": False, "bash_command": "a\n\tb\x07c", "mcp_server": ""}, "tool     Bash fail a b c"),
        ({"kind": "tool_result", "tool_name": "x", "success": True, "bash_command": "", "mcp_server": "srv"}, "tool     x ok mcp=srv"),
        ({"kind": "user_prompt", "prompt_length": 7}, "prompt   len=7"),
    ],
)
def test_tail_line(row, want):
    assert lines.tail_line(row | {"ts_ms": 3_723_000}) == f"[01:02:03] {want}"


def test_cells_are_cut_by_bytes():
    assert lines.cell("x" * 80) == "x" * 80 and lines.cell("x" * 81) == "x" * 77 + "..."
    assert len(lines.cell("é" * 60).encode()) <= 82 and lines.cell(" a   b ") == "a b"


def test_report_of_a_session(spark):
    t = Telemetry.of(spark, SF)
    latest = sessions.latest_session(t).first()["id"]
    out = report.last(t, n=3)
    assert out == report.last(t, latest, 3) and out[0].startswith(f"session {latest[:8]}  ")
    rejects = t.tool_decisions.where((F.col("session_id") == latest) & (F.col("decision") == "reject")).count()
    assert sum(line.startswith(f"  {lines.REJECT}") for line in out) == rejects
    assert out[2 + rejects] == "bash (last 3)" and 3 + rejects < len(out) <= 10 + rejects
    assert report.status_line(t, latest) == report.status_line(t) == report.status_line(t, "nobody") != ""
    with pytest.raises(sessions.NotFound):
        report.last(t, "nobody")
    rows = timeline.log_rows(t).where(F.col("session_id") == latest).count()
    assert len(report.tail(t, latest, 5)) == min(5, rows) and all(line.startswith("[") for line in report.tail(t, n=4))
