"""Flattening: every path of a document with its captured values."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.config import Limits
from stratadoc.functions.canonical import canonical_json


def flatten_value(value: object, limits: Limits = Limits()) -> list[tuple[str, str | None]]:
    """(path, canonical value or None) of every node below the root.

    Members add `.name`, elements `[]`. Objects and arrays have no value, nor have atoms over the size limit. A
    container with too many elements keeps its path, but what it holds is left out; the root is always explored.
    """
    rows: list[tuple[str, str | None]] = []
    stack = [("", value)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            below = [(f"{path}.{k}", v) for k, v in node.items()]
        elif isinstance(node, list):
            below = [(f"{path}[]", v) for v in node]
        else:
            text = canonical_json(node)
            rows.append((path, text if len(text) * 4 <= limits.value_bytes or len(text.encode()) <= limits.value_bytes else None))
            continue
        if path:
            rows.append((path, None))
        if not path or len(below) <= limits.container_elements:
            stack.extend(below)
    return rows


def index_entries(nodes: list[tuple[str, str | None]]) -> list[tuple[str, str | None]]:
    """The index rows of a record: all captured values, and one row without value for each path that has none."""
    captured = [n for n in nodes if n[1] is not None]
    with_value = {p for p, _ in captured}
    return captured + [(p, None) for p in sorted({p for p, _ in nodes} - with_value)]


def shape_hash(paths: list[str]) -> str:
    """SHA-256 over the sorted paths, each followed by a newline."""
    return hashlib.sha256("".join(f"{p}\n" for p in paths).encode()).hexdigest()


def field_index(records: DataFrame) -> DataFrame:
    """(namespace, key_name, record_id, value) rows of records with entries."""
    return records.select("namespace", "record_id", F.inline("entries"))
