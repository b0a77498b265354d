"""From JSON lines to records: validation, identity, time, hashes and index entries in one Arrow pass.

Canonical text decides hashes and equality, and its numbers need the fewest digits that give a double, for which
Spark has no function. As each document is thus parsed in Python once, all that depends on the
parsed form is computed there too, in batches; what follows is joins and aggregates over columns.

Of several errors of a line, the first in this order is reported: JSON, size, object, number of paths, false friends,
record id, entity id, timestamp, superseded id, lock.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.config import Limits
from stratadoc.errors import EngineError
from stratadoc.functions.canonical import canonical_json, canonical_string, parsed_with_text
from stratadoc.functions.timestamps import interpret
from stratadoc.operators.flatten import flatten_value, index_entries, shape_hash

# Reserved top-level keys, in the order in which they are looked for.
RECORD_ID_KEYS = ("record_id", "record_uuid", "event_id", "event_uuid", "id", "uuid")
ENTITY_ID_KEYS = ("entity_id", "entity_uuid")
TIMESTAMP_KEYS = ("timestamp", "record_timestamp", "event_timestamp", "record_time", "event_time", "time")
DELETION_MARKER = "_deletion_marker"
SUPERSEDES = "supersedes_id"
LOCKED_UNTIL = "locked_until"
OWN_KEYS = frozenset((*RECORD_ID_KEYS, *ENTITY_ID_KEYS, *TIMESTAMP_KEYS))
FALSE_FRIENDS = ("supersedes_uuid", "supersedes", "locked_until_time", "locked_until_timestamp")
ZERO_UUID = "00000000-0000-0000-0000-000000000000"
HYPHENATED = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
UUID = re.compile(rf"(?:(?:urn:uuid:)?{HYPHENATED}|\{{{HYPHENATED}\}}|[0-9a-f]{{32}})", re.IGNORECASE | re.ASCII)

SMALL_BYTES, TASK_BYTES = 256 << 10, 32 << 20
PARSED_SCHEMA = (
    "index long, error_id string, record_id string, explicit_entity_id string, record_micros long, record_hash string, shape_hash string, content_hash string, "
    "record_data string, lock_micros long, supersedes_id string, is_deletion_marker boolean, paths array<string>, entries array<struct<key_name:string,value:string>>"
)
ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<struct<key_name:string,value:string>>": pa.list_(pa.struct([("key_name", pa.string()), ("value", pa.string())]))}
FIELDS = [c.split(" ", 1) for c in re.split(r", (?=\w+ )", PARSED_SCHEMA)]


def normal_uuid(text: str) -> str | None:
    """The lower-case hyphenated form of a UUID text; None if it is none."""
    if not UUID.fullmatch(text):
        return None
    d = text.lower().removeprefix("urn:uuid:").strip("{}").replace("-", "")
    return f"{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:]}"


def identity(document: dict, keys: tuple[str, ...], kind: str) -> str | None:
    """The UUID under the first key that is present, even if it is null; None if there is no key."""
    key = next((k for k in keys if k in document), None)
    if key is None:
        return None
    if not isinstance(document[key], str):
        raise EngineError(f"bad_record.{kind}.invalid.not_a_string")
    found = normal_uuid(document[key])
    if found is None:
        raise EngineError(f"bad_record.{kind}.invalid.bad_uuid")
    if found == ZERO_UUID:
        raise EngineError(f"bad_record.{kind}.zero_uuid")
    return found


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def parse_record(line: str | None, limits: Limits = Limits(), semantics: str = "reference") -> dict:
    """The parsed columns of one line, without index, entries as (key_name, value); raises an EngineError for a bad one."""
    text = (line or "").strip()
    if "\n" in text:
        raise EngineError("bad_record.multiline")
    if len(text.encode()) > limits.record_bytes:
        raise EngineError("bad_record.too_long")
    try:
        document, canonical = parsed_with_text(text)
        size = len(canonical.encode())
    except (ValueError, RecursionError):
        raise EngineError("bad_record.invalid_json") from None
    if size > limits.record_bytes:
        raise EngineError("bad_record.too_long")
    if not isinstance(document, dict):
        raise EngineError("bad_record.not_an_object")
    nodes = flatten_value(document, limits)
    paths = sorted({p for p, _ in nodes})
    if len(paths) > limits.total_keys:
        raise EngineError("bad_record.too_many_fields")
    if any(k in document for k in FALSE_FRIENDS):
        raise EngineError("bad_record.false_friend")
    record_id = identity(document, RECORD_ID_KEYS, "record_id")
    if record_id is None:
        raise EngineError("bad_record.missing_id")
    entity_id = identity(document, ENTITY_ID_KEYS, "entity_id")
    time_key = next((k for k in TIMESTAMP_KEYS if k in document), None)
    if time_key is None or document[time_key] is None:
        raise EngineError("bad_record.missing_timestamp")
    micros = interpret(document[time_key], semantics)
    supersedes = document.get(SUPERSEDES)
    if isinstance(supersedes, str):
        supersedes = normal_uuid(supersedes)
        if supersedes is None:
            raise EngineError("bad_record.invalid_supersedes_id")
    lock = None
    if isinstance(document.get(LOCKED_UNTIL), str):
        try:
            lock = interpret(document[LOCKED_UNTIL], semantics)
        except EngineError:
            raise EngineError("bad_record.invalid_locked_until") from None
    own = ",".join(f"{canonical_string(k)}:{canonical_json(document[k])}" for k in sorted(document) if k not in OWN_KEYS)
    return {
        "record_id": record_id,
        "explicit_entity_id": entity_id,
        "record_micros": micros,
        "record_hash": sha256(canonical),
        "shape_hash": shape_hash(paths),
        "content_hash": sha256(f"{{{own}}}"),
        "record_data": canonical,
        "lock_micros": lock,
        "supersedes_id": supersedes if isinstance(supersedes, str) else None,
        "is_deletion_marker": DELETION_MARKER in document,
        "paths": paths,
        "entries": index_entries(nodes),
    }


def spread(lines: DataFrame) -> DataFrame:
    """The lines dealt to all cores if the optimizer expects too few bytes for the scan to be cut into that many tasks:
    parsing costs far more than moving them. Large inputs, and single requests, stay as they are."""
    size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartition(cores) if SMALL_BYTES < size < cores * TASK_BYTES else lines


def parse_lines(lines: DataFrame, namespace: str, limits: Limits = Limits(), semantics: str = "reference") -> DataFrame:
    """Records, or an error_id, for lines(index, line): the columns of the records table, paths and entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch, rows = whole.slice(at, 1000), []
                for line in batch.column(1).to_pylist():
                    try:
                        rows.append(parse_record(line, limits, semantics))
                    except EngineError as e:
                        rows.append({"error_id": e.error_id})
                plain = [pa.array([r.get(n) for r in rows], ARROW[k]) for n, k in FIELDS[1:-1]]
                entries = [r.get("entries") for r in rows]
                cuts = np.cumsum([0, *(len(e or ()) for e in entries)])
                pairs = [p for e in entries if e for p in e]
                both = pa.StructArray.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())], names=["key_name", "value"])
                listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), both, mask=pa.array([e is None for e in entries]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *plain, listed], names=[n for n, _ in FIELDS])

    parsed = spread(lines.selectExpr("cast(index as long) index", "cast(line as string) line")).mapInArrow(run, PARSED_SCHEMA)
    return parsed.select(
        "index",
        F.lit(namespace).alias("namespace"),
        "error_id",
        "record_id",
        "explicit_entity_id",
        F.timestamp_micros("record_micros").alias("record_timestamp"),
        "record_hash",
        "shape_hash",
        "content_hash",
        "record_data",
        F.timestamp_micros("lock_micros").alias("locked_until"),
        "supersedes_id",
        "is_deletion_marker",
        "paths",
        "entries",
    )
