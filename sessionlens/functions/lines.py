"""Rows as lines of text: the log line, the status line, and the report of a session."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime
from zoneinfo import ZoneInfo

from . import formats

#: How the report and the log name things, and the bytes of a cell.
REJECT, NOT_STORED, CELL = "✕ reject", "미저장", 80


def clock(ts_ms: int, tz: str = "UTC") -> str:
    return datetime.fromtimestamp(ts_ms / 1000, ZoneInfo(tz)).strftime("%H:%M:%S")


def cell(text: str, limit: int = CELL) -> str:
    """White space, control characters and U+FFFD as single spaces; at most `limit` bytes of UTF-8, the last three dots."""
    line = " ".join("".join(" " if c.isspace() or ord(c) < 32 or 127 <= ord(c) < 160 or c == "�" else c for c in text).split(" ")).strip()
    line = " ".join(line.split())
    data = line.encode()
    return line if len(data) <= limit else data[: limit - 3].decode("utf-8", "replace") + "..."


def tail_line(row: Mapping, tz: str = "UTC") -> str:
    """One row of timeline.log_rows()."""
    kind = row["kind"]
    if kind == "api_request":
        name, said = "api", f"{row['model']} in={row['input_tokens']} out={row['output_tokens']} cost={formats.cost(row['cost_usd'], 4)} dur={formats.duration(row['duration_ms'])}"
    elif kind == "api_error":
        name, said = "error", f"{row['model']} status={row['status_code']}"
    elif kind == "tool_decision":
        name, said = "decision", f"{row['decision']} {row['tool_name']}" + (f" (source={row['source']})" if row["source"] else "")
    elif kind == "tool_result":
        more = f" {cell(row['bash_command'])}" if row["bash_command"] else f" mcp={row['mcp_server']}" if row["mcp_server"] else ""
        name, said = "tool", f"{row['tool_name']} {'ok' if row['success'] else 'fail'}{more}"
    elif kind == "user_prompt":
        name, said = "prompt", f"len={row['prompt_length']}" if row["prompt_length"] else ""
    else:
        name, said = kind, ""
    return f"[{clock(row['ts_ms'], tz)}] {name:<8} {said}"


def status_line(row: Mapping) -> str:
    """One row of sessions.snapshots()."""
    parts = [formats.cost(row["cost_usd"]), f"in {formats.tokens(row['input_tokens'])}/out {formats.tokens(row['output_tokens'])}", f"cache {formats.percent(row['cache_hit_ratio'])}"]
    parts += [f"⊘{row['tool_reject']} reject"] * (row["tool_reject"] > 0) + [row["last_tool"]] * bool(row["last_tool"])
    return " · ".join(parts)


def report(session: Mapping, rejects: Iterable[Mapping], results: Iterable[Mapping], prompts: Iterable[Mapping], n: int, tz: str = "UTC") -> list[str]:
    """Lines of one session: its snapshot, its rejected calls, and its last n results and prompts, oldest first."""
    head = f"session {formats.short_id(session['id'])}  {formats.time_range(session['first_seen'], session['last_seen'], tz)}  cost={formats.cost(session['cost_usd'], 4)}"
    head += f"  in={formats.tokens(session['input_tokens'])} out={formats.tokens(session['output_tokens'])}  cache_hit={formats.percent(session['cache_hit_ratio'])}"
    out = [head + "  (metrics-only)" * (session["token_source"] == "metrics"), f"tools  accept {session['tool_accept']}  reject {session['tool_reject']}  auto-approved {session['auto_approved']}"]
    out += [f"  {REJECT}  {formats.or_dash(r['tool_name'])}" + (f" (source={r['source']})" if r["source"] else "") for r in rejects]
    out.append(f"bash (last {n})")
    for r in results:
        command = r["bash_command"] or (f"mcp={r['mcp_server']}" if r["mcp_server"] else formats.or_dash(r["tool_name"]))
        out.append(f"  {clock(r['ts_ms'], tz)}  {'ok  ' if r['success'] else 'fail'} {cell(command)}")
    prompts = list(prompts)
    if prompts:
        out.append(f"prompts (last {n})")
        out += [f"  {clock(p['ts_ms'], tz)}  " + (cell(p["prompt"]) if p["stored"] else f"({NOT_STORED}, len={p['prompt_length']})") for p in prompts]
    return out
