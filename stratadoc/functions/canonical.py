"""Canonical JSON text of requests and records.

Members by code point, no white space, integers without point or exponent, other numbers as d.dddE±x with the
fewest digits that give the same double, and the shortest escapes.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

EXACT = 1 << 53
UNESCAPED = re.compile(r'[^"\\\x00-\x1f]*')
ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def canonical_number(x: float | int) -> str:
    if type(x) is int and -EXACT < x < EXACT:
        return str(x)
    d = float(x)
    if math.isinf(d) or math.isnan(d):
        raise ValueError("not a JSON number")
    if d == int(d):
        return str(int(d))
    mantissa, _, exponent = repr(abs(d)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    power = int(exponent or 0) + (len(whole) - 1 if whole.strip("0") else -1 - (len(part) - len(part.lstrip("0"))))
    digits = digits.rstrip("0") or "0"
    return f"{'-' if d < 0 else ''}{digits[0]}.{digits[1:] or '0'}E{power}"


def canonical_string(s: str) -> str:
    if UNESCAPED.fullmatch(s):
        return f'"{s}"'
    return '"' + "".join(ESCAPES.get(c) or (f"\\u{ord(c):04X}" if c < " " else c) for c in s) + '"'


def canonical_json(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return canonical_number(value)
    if isinstance(value, str):
        return canonical_string(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical_string(k)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    raise TypeError(f"not a JSON value: {value!r}")


def refuse(name: str) -> None:
    raise ValueError(f"invalid JSON constant {name}")


def number(literal: str) -> float:
    if math.isinf(d := float(literal)):
        raise ValueError("a number is out of range")
    return d


DECODER = json.JSONDecoder(parse_constant=refuse, parse_float=number, parse_int=number)


def parse_json(text: str) -> object:
    """Python values of JSON text; NaN, infinities and numbers beyond doubles are refused; the last of equal keys stays."""
    return DECODER.decode(text)


def first_json(text: str) -> object:
    """The first value of the text; what follows it is not looked at."""
    return DECODER.raw_decode(text, len(text) - len(text.lstrip(" \t\r\n")))[0]


class Special(ValueError):
    """A document that the plain way does not cover."""


def special(_: str) -> None:
    raise Special


#: Digits of an integer that a double may not hold, or control signs, whose escapes differ.
PLAIN_LIMIT = re.compile(r"[0-9]{16}|\\u00|[\x00-\x1f]", re.ASCII)
PLAIN_DECODER = json.JSONDecoder(parse_constant=special, parse_float=special)
PLAIN_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False)


def parsed_with_text(text: str) -> tuple[object, str]:
    """(value, canonical text). Texts of short integers, strings without control signs and containers, the usual case, take
    the library's own encoder, whose result is canonical for them; all others are encoded as above."""
    if not PLAIN_LIMIT.search(text):
        try:
            value = PLAIN_DECODER.decode(text)
            return value, PLAIN_ENCODER.encode(value)
        except Special:
            pass
    value = parse_json(text)
    return value, canonical_json(value)


def record_hash(canonical: str) -> str:
    return hashlib.sha256(canonical.encode()).hexdigest()
