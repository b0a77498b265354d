"""Requests and their compilation: a JSON query becomes present tests, value tests, flags, a time range and an order."""

from __future__ import annotations

from dataclasses import dataclass, field

from stratadoc.config import Limits
from stratadoc.errors import EngineError
from stratadoc.functions.canonical import canonical_json, first_json, parse_json
from stratadoc.functions.timestamps import interpret

FIELDS = ("wildcard", "filter", "exclude", "raw", "omit_superseded", "omit_hidden", "omit_locked", "treat_nulls_as_absent", "timestamp_start", "timestamp_end", "order_by", "limit")
ORDERS = ("id", "time", "random")


def invalid(message: str, **data: object) -> EngineError:
    return EngineError("bad_request.invalid_request", message, **data)


def known_fields(value: object, names: tuple[str, ...], where: str) -> dict:
    """The members by their names; names match in any case, nulls are absent, others are refused."""
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise invalid(f"{where} is not an object")
    out = {}
    for key, v in value.items():
        name = next((n for n in names if n.lower() == key.lower()), None)
        if name is None:
            raise invalid(f"unknown field {key!r} in {where}", field=key)
        if v is not None:
            out[name] = v
    return out


def order_of(text: str) -> tuple[str, bool]:
    """(what, descending) of `[-](id|time|random)`."""
    if not isinstance(text, str) or text.removeprefix("-") not in ORDERS or not text:
        raise invalid(f"invalid order: {text!r}")
    return text.removeprefix("-"), text.startswith("-")


def leaves(value: object, path: str = "") -> list[tuple[str, object]]:
    """(path, atom) of a filter document; empty containers give none."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaves(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v, f"{path}[]")]
    return [(path, value)]


@dataclass
class Predicates:
    """Tests by path, in the order given."""

    present: list[str] = field(default_factory=list)
    values: dict[str, list[str]] = field(default_factory=dict)

    def paths(self) -> list[str]:
        return list(dict.fromkeys([*self.present, *self.values]))


@dataclass
class CompiledQuery:
    filter: Predicates
    exclude: Predicates
    omit_superseded: bool = True
    omit_hidden: bool = True
    omit_locked: bool = False
    treat_nulls_as_absent: bool = True
    start: int | None = None
    end: int | None = None
    order: tuple[str, bool] = ("time", False)
    limit: int = 1000


def predicates(document: object, wildcard: str, raw: dict, limits: Limits) -> Predicates:
    out = Predicates()
    if document is not None and not isinstance(document, dict):
        raise invalid("a filter is not an object")
    for path, atom in leaves(document or {}):
        text = canonical_json(atom)
        if text == wildcard:
            if path not in out.present:
                out.present.append(path)
        elif len(text.encode()) <= limits.value_bytes and text not in out.values.setdefault(path, []):
            out.values[path].append(text)
    for path in raw.get("fields_present") or []:
        if path not in out.present:
            out.present.append(path)
    for path, texts in (raw.get("field_values") or {}).items():
        known = out.values.setdefault(path, [])
        known += [t for t in texts if t not in known]
    out.values = {p: v for p, v in out.values.items() if v}
    return out


def compile_query(request: dict | str, limits: Limits = Limits(), semantics: str = "reference") -> CompiledQuery:
    """The compiled form of a request, given as JSON text or as its Python value."""
    if isinstance(request, str):
        try:
            request = first_json(request) if semantics == "reference" else parse_json(request)
        except ValueError as e:
            raise invalid(f"invalid JSON: {e}") from None
    q = known_fields(request, FIELDS, "the query")
    raw = known_fields(q.get("raw"), ("filter", "exclude"), "raw")
    parts = {k: known_fields(raw.get(k), ("fields_present", "field_values"), f"raw.{k}") for k in ("filter", "exclude")}
    wildcard = canonical_json((request or {}).get("wildcard")) if "wildcard" in q else "null"
    for name in ("omit_superseded", "omit_hidden", "omit_locked", "treat_nulls_as_absent"):
        if not isinstance(q.get(name, True), bool):
            raise invalid(f"{name} is not a boolean")
    limit = q.get("limit", limits.query_rows)
    if isinstance(limit, bool) or not isinstance(limit, (int, float)) or limit != int(limit):
        raise invalid("limit is not an integer")
    bound = lambda name: None if name not in q else interpret(q[name], semantics)
    return CompiledQuery(
        predicates(q.get("filter"), wildcard, parts["filter"], limits),
        predicates(q.get("exclude"), wildcard, parts["exclude"], limits),
        q.get("omit_superseded", True),
        q.get("omit_hidden", True),
        q.get("omit_locked", False),
        q.get("treat_nulls_as_absent", True),
        bound("timestamp_start"),
        bound("timestamp_end"),
        order_of(q["order_by"]) if "order_by" in q else ("time", False),
        int(limit),
    )
