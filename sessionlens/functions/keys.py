"""Dedup and series keys, and the small scalar functions of the telemetry model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"


def dedup_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by NUL; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(NUL, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def ms_to_ns_text(ms: Column) -> Column:
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit("0")).otherwise((ms * 1_000_000).cast("string"))


def ns_to_ms(ns: Column) -> Column:
    """Whole milliseconds; the remainder goes first, as a double can't hold every nanosecond."""
    return F.round((ns - ns % F.lit(1_000_000)) / F.lit(1_000_000)).cast("long")


def api_request_key(session: Column, event: Column, ts_ns: Column, model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    return dedup_key(session, event, ts_ns, model, input_tokens, output_tokens)


def tool_result_key(session: Column, ts_ns: Column, tool: Column, tool_use_id: Column | None = None) -> Column:
    return dedup_key(session, F.lit("tool_result"), ts_ns, tool, *([] if tool_use_id is None else [tool_use_id]))


def tool_decision_key(session: Column, ts_ns: Column, tool: Column, decision: Column, source: Column) -> Column:
    return dedup_key(session, F.lit("tool_decision"), ts_ns, tool, decision, source)


def event_key(session: Column, name: Column, ts_ns: Column, extra: Column) -> Column:
    return dedup_key(session, name, ts_ns, extra)


def series_key(name: Column, dims: Column) -> Column:
    """Full SHA-256 of the metric name and its dimensions (a map) as NUL k=v in key order."""
    pairs = F.transform(F.array_sort(F.map_entries(dims)), lambda e: F.concat(F.lit(NUL), e["key"], F.lit("="), e["value"]))
    return F.sha2(F.concat(name, F.array_join(pairs, "")), 256)


def parse_time_ms(text: Column) -> Column:
    """RFC 3339 to unix milliseconds; 0 for what can't be read."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(F.trim(text))), F.lit(0))


def repo_of(path: Column) -> Column:
    """Last part of a working directory; empty for none, '.', '/' or a bare drive."""
    slashes = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"\\", "/"), r"/+$", "")
    last = F.element_at(F.split(slashes, "/"), -1)
    return F.when(last.isin("", ".") | last.rlike("^[A-Za-z]:$"), F.lit("")).otherwise(last)


def mcp_server(tool: Column) -> Column:
    return F.regexp_extract(F.coalesce(tool, F.lit("")), r"^mcp__(.*?)(?:__|$)", 1)


def event_name(name: Column, attribute: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(F.nullif(name, F.lit("")), attribute, F.lit(""))), r"^claude_code\.", "")


def first_text(*columns: Column) -> Column:
    """The first that isn't blank, trimmed, else empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))


def to_long(text: Column) -> Column:
    """Whole number of a text: as is, or a decimal cut off; 0 for what isn't one."""
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"), F.lit(0))


def to_double(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def to_bool(text: Column) -> Column:
    return F.coalesce(text.isin("1", "t", "T", "TRUE", "true", "True"), F.lit(False))


def status_text(code: Column) -> Column:
    return F.when(code == 1, "ok").when(code == 2, "error").otherwise("unset")


def bucket(ts_ms: Column, width_ms: int) -> Column:
    """Start of the UTC bucket; whole-number division, so exact for all ms since 1970."""
    return ts_ms - ts_ms % F.lit(width_ms)


#: Fixed value: what stands for a value that isn't stored.
MASK = "[redacted]"
#: Attributes that are masked when prompts aren't stored.
SENSITIVE = ("prompt", "prompt_text", "user_prompt", "content", "message", "tool_parameters", "command", "full_command", "bash_command")


def redacted(attributes: Column, mask: str = MASK) -> Column:
    """A string map with the values of sensitive keys masked."""
    return F.transform_values(attributes, lambda k, v: F.when(k.isin(*SENSITIVE), F.lit(mask)).otherwise(v))


def single_line(text: Column, limit: int = 80) -> Column:
    """Runs of white space, control characters and U+FFFD as one space; at most `limit` bytes of UTF-8, the last three dots. A character that the cut would halve becomes U+FFFD."""
    line = F.trim(F.regexp_replace(text, r"(?U)[\s\p{Cntrl}�]+", " "))
    cut = F.make_valid_utf8(F.substring(line.cast("binary"), 1, limit - 3).cast("string"))
    return F.when(F.octet_length(line) > limit, F.concat(cut, F.lit("..."))).otherwise(line)
