"""Timestamps of records and of query bounds: numbers and integer strings in s, ms, us or ns, or RFC 3339.

Reference semantics keep the scaling of sub-second parts that stored data relies on: of a number, the fraction in
its own unit is taken as a fraction of a second; of an integer string, the remainder is taken as nanoseconds.
Intended semantics scale exactly. Stored values are rounded to microseconds.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from stratadoc.errors import EngineError

UNITS = (1, 1_000, 1_000_000, 1_000_000_000)
FIRST, LAST = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (2000, 2101))  # years 2000 to 2100
RFC3339 = re.compile(r"(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})", re.ASCII)
INTEGER = re.compile(r"[+-]?\d{1,19}", re.ASCII)


def bad(value: object) -> EngineError:
    return EngineError("invalid_timestamp", f"invalid timestamp: {value!r}", value=str(value))


def interpret(value: object, semantics: str = "reference") -> int:
    """Microseconds since 1970 of a JSON value."""
    exact = semantics == "intended"
    if isinstance(value, bool):
        raise bad(value)
    if isinstance(value, (int, float)):
        for unit in UNITS:
            seconds = value / unit
            if FIRST <= seconds < LAST:
                if exact:
                    return round(value * (1_000_000 / unit)) if isinstance(value, float) else round(value * 1_000_000 / unit)
                whole = int(seconds)
                fraction = value - whole * unit
                return whole * 1_000_000 + round(fraction * 1_000_000)
        raise bad(value)
    if not isinstance(value, str):
        raise bad(value)
    if INTEGER.fullmatch(value):
        n = int(value)
        for unit in UNITS:
            if FIRST <= n // unit < LAST:
                return (n * 1_000_000 + unit // 2) // unit if exact else n // unit * 1_000_000 + (n % unit + 500) // 1000
        raise bad(value)
    m = RFC3339.fullmatch(value)
    if not m:
        raise bad(value)
    try:
        base = datetime.fromisoformat(f"{m[1]}T{m[2]}{'+00:00' if m[4] == 'Z' else m[4]}")
    except ValueError:
        raise bad(value) from None
    nanos = int((m[3] or "0")[:9].ljust(9, "0"))
    return (base - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1) + (nanos + 500) // 1000
