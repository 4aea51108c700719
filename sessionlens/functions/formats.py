"""Text at the edge: costs, counts, durations, periods and sizes."""

from __future__ import annotations

import re
from datetime import datetime
from zoneinfo import ZoneInfo

#: Periods of the filters, in days; units of durations in seconds and of sizes in bytes (decimal names count binary too).
PERIODS = {"7d": 7, "30d": 30, "90d": 90, "1y": 365, "all": None}
UNITS = {"d": 86400, "h": 3600, "m": 60, "s": 1}
SIZES = {"": 1, "b": 1, "kb": 1 << 10, "kib": 1 << 10, "mb": 1 << 20, "mib": 1 << 20, "gb": 1 << 30, "gib": 1 << 30}


def since_of(period: str, now_ms: int) -> int:
    """Start of a period; 0 is no limit."""
    days = PERIODS[period]
    return 0 if days is None else now_ms - days * 86_400_000


def cost(usd: float, digits: int = 2) -> str:
    return f"${max(0.0, usd):.{digits}f}"


def tokens(n: int) -> str:
    """Grouped below 1,000, else thousands or millions with one decimal, none where it would be 0."""
    n = max(0, n)
    if n < 1_000:
        return str(n)
    size, unit = (1e6, "M") if n >= 1_000_000 else (1e3, "K")
    return f"{n / size:.1f}".removesuffix(".0") + unit


def grouped(n: int) -> str:
    return f"{max(0, n):,}"


def percent(share: float) -> str:
    """Whole percent; halves round up."""
    return f"{int(max(0.0, share) * 100 + 0.5)}%"


def duration(ms: int) -> str:
    """Milliseconds as 250ms, 1.5s or 62m 0s."""
    if ms < 1_000:
        return f"{ms}ms"
    if ms < 60_000:
        return f"{ms / 1000:.1f}s"
    return f"{ms // 60_000}m {ms // 1000 % 60}s"


def time_range(first_ms: int, last_ms: int, tz: str = "UTC") -> str:
    """Clock times of a session and how long it took."""
    clock = lambda ms: datetime.fromtimestamp(ms / 1000, ZoneInfo(tz)).strftime("%H:%M")
    return f"{clock(first_ms)}–{clock(last_ms)} ({duration(max(0, last_ms - first_ms))})"


def or_dash(text: str) -> str:
    return text or "-"


def short_id(session: str) -> str:
    return session[:8]


def parse_duration(text: str) -> int:
    """Seconds of texts like 90d, 72h, 1h30m."""
    parts = re.findall(r"(\d+)([dhms])", text.strip().lower())
    if not parts or "".join(n + u for n, u in parts) != text.strip().lower():
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * UNITS[u] for n, u in parts)


def parse_size(text: str) -> int:
    """Bytes of texts like 16MB, 32 MiB, 512."""
    m = re.fullmatch(r"(\d+)\s*([a-z]*)", text.strip().lower())
    if not m or m[2] not in SIZES:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * SIZES[m[2]]
