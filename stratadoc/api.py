"""The engine's calls, as methods: queries give DataFrames or response dictionaries, writes give dictionaries."""

from __future__ import annotations

import base64
import json
import time
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from stratadoc.config import Config
from stratadoc.errors import EngineError
from stratadoc.functions.canonical import canonical_string
from stratadoc.operators import ingest
from stratadoc.operators.metadata import normal_uuid
from stratadoc.plans import planner
from stratadoc.plans.spec import compile_query
from stratadoc.sources.jsonl import body_lines, lines_frame
from stratadoc.sources.store import Store


def basic_login(header: str) -> tuple[str | None, str | None]:
    """(name, secret) of a basic Authorization header; (None, None) of any other."""
    kind, _, text = header.partition(" ")
    try:
        name, colon, secret = base64.b64decode(text, validate=True).decode().partition(":")
    except ValueError:
        return None, None
    return (name, secret) if kind.lower() == "basic" and colon else (None, None)


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config = Config()):
        self.spark, self.config = spark, config
        self.store = Store(spark, root, config)

    # queries

    def _compiled(self, request: dict | str):
        return compile_query(request, self.config.limits, self.config.semantics)

    def records(self, namespace: str, request: dict | str, now: object | None = None) -> DataFrame:
        c = self.store.collection(namespace)
        return planner.records_query(c, self._compiled(request), self.config.semantics, now)

    def lists(self, namespace: str, requests: list[dict | str]) -> DataFrame:
        """(query, record_id) of several requests, in their order."""
        return planner.lists_query(self.store.collection(namespace), [self._compiled(r) for r in requests], self.config.semantics)

    def fields(self, namespace: str, request: dict | str) -> DataFrame:
        return planner.fields_query(self.store.collection(namespace), self._compiled(request), self.config.semantics, self.config.limits.query_rows)

    def values(self, namespace: str, fields: str | list[str], request: dict | str) -> DataFrame:
        names = [fields] if isinstance(fields, str) else fields
        if not all(names):
            raise EngineError("bad_request.missing_field_name", "a field name is needed")
        return planner.values_query(self.store.collection(namespace), self._compiled(request), names, self.config.semantics, self.config.limits.query_rows)

    def records_response(self, namespace: str, request: dict | str) -> dict:
        return {"records": self._decoded(namespace, self.records(namespace, request))}

    def _decoded(self, namespace: str, rows: DataFrame) -> list[dict]:
        text = planner.envelope(rows, namespace).selectExpr("to_json(struct(*)) j")
        return [json.loads(r.j) for r in text.toLocalIterator()]

    def fields_response(self, namespace: str, request: dict | str) -> dict:
        rows = [{"field": r.field, "count": r["count"], "values": None} for r in self.fields(namespace, request).collect()]
        return {"fields": rows or None}

    def values_response(self, namespace: str, fields: str | list[str], request: dict | str) -> dict:
        rows = self.values(namespace, fields, request).collect()
        return {"fields": [{"field": r.field, "count": r["count"], "values": [{"value": json.loads(v["value"]), "count": v["count"]} for v in r["values"]]} for r in rows]}

    def record(self, namespace: str, record_id: str) -> dict:
        found = normal_uuid(record_id)
        if found is None:
            raise EngineError("bad_request.bad_record_id", "not a record id", record_id=record_id)
        return self._single(namespace, planner.lookup_record(self.store.collection(namespace), found), record_id=found)

    def entity(self, namespace: str, entity_id: str) -> dict:
        found = normal_uuid(entity_id)
        if found is None:
            raise EngineError("bad_request.bad_entity_id", "not an entity id", entity_id=entity_id)
        return self._single(namespace, planner.lookup_entity(self.store.collection(namespace), found), entity_id=found)

    def by_field(self, namespace: str, field: str, value: str) -> dict:
        rows = planner.lookup_field(self.store.collection(namespace), field, canonical_string(value))
        found = self._decoded(namespace, rows)
        if len(found) > 1:
            raise EngineError("lookup_error.multiple_records", "several records have the value", field=field)
        if not found:
            raise EngineError("not_found.record", "no such record", field=field)
        return found[0]

    def _single(self, namespace: str, rows: DataFrame, **asked: str) -> dict:
        found = self._decoded(namespace, rows)
        if not found:
            raise EngineError("not_found.record", "no such record", **asked)
        return found[0]

    def stats(self, namespace: str) -> dict:
        out = planner.stats(self.store.collection(namespace)).first().asDict()
        sizes = self.store.sizes()
        chars = out["record_chars"] or 0
        return {**out, "table_bytes": sizes, "expansion_factor": sum(sizes.values()) / chars if chars else None}

    # writes

    def write_record(self, namespace: str, body: str) -> dict:
        return ingest.insert_one(self.store, self.config.check_namespace(namespace), ingest.document_text(body, self.config.semantics))

    def upsert(self, namespace: str, body: str) -> tuple[int, dict]:
        """(status, response): 201 if a version was written, 200 if nothing changed."""
        out = ingest.upsert(self.store, self.config.check_namespace(namespace), ingest.document_text(body, self.config.semantics))
        return (201 if out["updated"] else 200), out

    def write_jsonl(self, namespace: str, body: str, batch_name: str | None = None) -> dict:
        lines = body_lines(body, self.config.limits, self.config.semantics)
        result = ingest.ingest_lines(self.store, namespace, lines_frame(self.spark, lines), batch_name)
        stats = result.summary()
        ranges = [{k: v for k, v in r.asDict().items() if v is not None} for r in ingest.status_ranges(result.status).collect()]
        for r in ranges:
            if "error_id" in r:
                r["error"] = r.pop("error_id")
        return {"stats": {k: v for k, v in stats.items() if k != "all_ok"}, "item_status": ranges, "all_ok": stats["all_ok"]}

    def check_batch(self, namespace: str, name: str) -> dict:
        self.config.check_namespace(namespace)
        row = planner.check_batches(self.store.read("processed_batches"), namespace, [name], self.spark).first()
        if not row.processed:
            raise EngineError("not_found.batch_not_found", "no such batch", batch_name=name)
        return {"batch_name": name, "status": "processed"}

    def check_batches(self, namespace: str, body: dict) -> dict:
        if not isinstance(body, dict) or set(body) - {"batch_names"}:
            raise EngineError("bad_request.invalid_request", "unknown field")
        self.config.check_namespace(namespace)
        rows = planner.check_batches(self.store.read("processed_batches"), namespace, body.get("batch_names") or [], self.spark).collect()
        return {"batches": [{"batch_name": r.batch_name, "status": "processed" if r.processed else "not_found"} for r in rows]}

    # one entry for all, by method and path

    def call(self, method: str, path: str, body: str = "", headers: dict[str, str] | None = None) -> tuple[int, dict]:
        """The response to a request of the HTTP surface: (status, body). headers: Host and Authorization (basic) decide, with
        the configured clients, whether the call is served; one that is not takes a second at least, whatever was wrong."""
        began, parts = time.monotonic(), [unquote(p) for p in path.split("?")[0].split("/") if p]
        given = {k.lower(): v for k, v in (headers or {}).items()}
        name, secret = basic_login(given.get("authorization", ""))
        if len(parts) > 2 and parts[0] == "api" and not self.config.allows(given.get("host"), name, secret, parts[2], parts[1]):
            time.sleep(max(0.0, began + self.config.limits.refusal_seconds - time.monotonic()))
            return 401, {"error": "Unauthorized"}
        try:
            return self._route(method, parts, body)
        except EngineError as e:
            return e.status, e.envelope()

    def _route(self, method: str, parts: list[str], body: str) -> tuple[int, dict]:
        match (method, *parts):
            case ("POST", "api", "query", ns, "records"):
                return 200, self.records_response(ns, body)
            case ("POST", "api", "query", ns, "fields"):
                return 200, self.fields_response(ns, body)
            case ("POST", "api", "query", ns, "values", field):
                return 200, self.values_response(ns, field, body)
            case ("GET", "api", "query", ns, "records", "by", field, value):
                return 200, self.by_field(ns, field, value)
            case ("GET", "api", "query", ns, "records", record_id):
                return 200, self.record(ns, record_id)
            case ("GET", "api", "query", ns, "entities", entity_id):
                return 200, self.entity(ns, entity_id)
            case ("POST", "api", "ingest", ns, "record"):
                return 200, self.write_record(ns, body)
            case ("POST", "api", "ingest", ns, "upsert"):
                return self.upsert(ns, body)
            case ("POST", "api", "ingest", ns, "jsonl"):
                return 200, self.write_jsonl(ns, body)
            case ("POST", "api", "ingest", ns, "batches", "check"):
                return 200, self.check_batches(ns, ingest.document_text(body, self.config.semantics))
            case ("GET", "api", "ingest", ns, "batches", name):
                return 200, self.check_batch(ns, name)
            case ("POST", "api", "ingest", ns, "batches", name, "jsonl"):
                return 200, self.write_jsonl(ns, body, name)
        raise EngineError("bad_request.no_such_endpoint", "no such endpoint")
