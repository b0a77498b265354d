"""Canonical text, timestamps, flattening and record metadata, on golden tables."""

import json

import pytest

from stratadoc.config import Limits
from stratadoc.errors import EngineError
from stratadoc.functions.canonical import canonical_json, canonical_number, parse_json
from stratadoc.functions.timestamps import interpret
from stratadoc.operators.flatten import flatten_value, index_entries, shape_hash
from stratadoc.operators.metadata import normal_uuid, parse_lines, parse_record

U = "f2be3a07-5796-e3a2-160e-b64c8664d105"


@pytest.mark.parametrize("x,text", [(42, "42"), (42.0, "42"), (4.2e1, "42"), (-0.0, "0"), (0.002, "2.0E-3"), (1e20, "1" + "0" * 20), (2e23, "199999999999999983222784"), (9007199254740993, "9007199254740992"), (3.14159, "3.14159E0"), (-123.5, "-1.235E2"), (1e-7, "1.0E-7"), (5e-324, "5.0E-324")])
def test_numbers(x, text):
    assert canonical_number(x) == text and float(text) == float(x)


def test_canonical_text():
    assert canonical_json({"b": [True, None, "é\"\\\n\x01\x7f"], "a": {}}) == '{"a":{},"b":[true,null,"é\\"\\\\\\n\\u0001\x7f"]}'
    assert parse_json('{"a":1,"a":2}') == {"a": 2}
    for bad in ("NaN", "1e999", "[Infinity]"):
        with pytest.raises(ValueError):
            parse_json(bad)


# seconds since 1970 of the base instant, and what is added to it
BASE = 1715316569


@pytest.mark.parametrize(
    "value,reference,intended",
    [
        (1715316569, BASE * 10**6, BASE * 10**6),
        (1715316569.25, BASE * 10**6 + 250_000, BASE * 10**6 + 250_000),
        (1715316569123, BASE * 10**6 + 123_000_000, BASE * 10**6 + 123_000),
        (1715316569123456, (BASE + 123456) * 10**6, BASE * 10**6 + 123_456),
        ("1715316569", BASE * 10**6, BASE * 10**6),
        ("1715316569123", BASE * 10**6, BASE * 10**6 + 123_000),
        ("1715316569123456", BASE * 10**6 + 123, BASE * 10**6 + 123_456),
        ("1715316569123456789", BASE * 10**6 + 123_457, BASE * 10**6 + 123_457),
        ("2024-05-10T04:49:29.9377255Z", BASE * 10**6 + 937_726, BASE * 10**6 + 937_726),
        ("2024-05-10T06:49:29+02:00", BASE * 10**6, BASE * 10**6),
        ("1995-01-01T00:00:00Z", 788918400 * 10**6, 788918400 * 10**6),
    ],
)
def test_timestamps(value, reference, intended):
    assert interpret(value) == reference and interpret(value, "intended") == intended


@pytest.mark.parametrize("value", ["1715316569.25", "x", "", 1, 1e30, None, True, [], "2024-02-30T00:00:00Z", "2024-01-01 00:00:00Z", "17"])
def test_bad_timestamps(value):
    with pytest.raises(EngineError) as e:
        interpret(value)
    assert e.value.error_id == "invalid_timestamp" and e.value.status == 400


def test_flatten_example():
    doc = {"id": U, "timestamp": 1715316569, "category": "c", "object": {"string": "h", "list": ["foo", "bar", "baz"], "integer": 42, "float": 3.14159}}
    rows = sorted(index_entries(flatten_value(doc)), key=str)
    assert rows == sorted([(".id", f'"{U}"'), (".timestamp", "1715316569"), (".category", '"c"'), (".object", None), (".object.string", '"h"'), (".object.list", None), *[(".object.list[]", f'"{x}"') for x in ("foo", "bar", "baz")], (".object.integer", "42"), (".object.float", "3.14159E0")], key=str)
    assert index_entries(flatten_value({"a": [{"x": 1}, {"x": 2}], "e": [], "o": {}})) and sorted(index_entries(flatten_value({"a": [{"x": 1}, {"x": 2}], "e": [], "o": {}})), key=str) == sorted([(".a", None), (".a[]", None), (".a[].x", "1"), (".a[].x", "2"), (".e", None), (".o", None)], key=str)


def test_flatten_limits():
    many = {str(i): i for i in range(1001)}
    assert len(flatten_value(many)) == 1001  # the root is not limited
    assert flatten_value({"a": list(range(1001))}) == [(".a", None)]
    assert len(flatten_value({"a": list(range(1000))})) == 1001
    assert flatten_value({"a": "x" * 1022}) == [(".a", '"' + "x" * 1022 + '"')] and flatten_value({"a": "x" * 1023}) == [(".a", None)]
    assert flatten_value({"a": "é" * 511}) == [(".a", '"' + "é" * 511 + '"')] and flatten_value({"a": "é" * 512}) == [(".a", None)]
    assert flatten_value({"a": {"b": 1}, "a.b": 2}) and {p for p, _ in flatten_value({"a": {"b": 1}, "a.b": 2})} == {".a", ".a.b"}
    deep: dict = {}
    at = deep
    for _ in range(300):
        at["n"] = {}
        at = at["n"]
    assert len(flatten_value(deep)) == 300
    assert shape_hash([".a", ".b"]) == __import__("hashlib").sha256(b".a\n.b\n").hexdigest()


def line(**more):
    return json.dumps({"id": U, "time": 1715316569, **more})


@pytest.mark.parametrize(
    "text,error",
    [
        ("", "bad_record.invalid_json"),
        ("\t", "bad_record.invalid_json"),
        ("{", "bad_record.invalid_json"),
        ("[1]", "bad_record.not_an_object"),
        ("3", "bad_record.not_an_object"),
        (line(x=1) + "\n" + line(), "bad_record.multiline"),
        (line(x="y" * (1 << 20)), "bad_record.too_long"),
        (line(**{str(i): i for i in range(1000)}), "bad_record.too_many_fields"),
        (line(supersedes=1), "bad_record.false_friend"),
        ('{"time":1715316569}', "bad_record.missing_id"),
        ('{"id":5,"time":1715316569}', "bad_record.record_id.invalid.not_a_string"),
        (json.dumps({"record_id": None, "id": U, "time": 1715316569}), "bad_record.record_id.invalid.not_a_string"),
        ('{"id":"x","time":1}', "bad_record.record_id.invalid.bad_uuid"),
        ('{"id":"00000000-0000-0000-0000-000000000000","time":1}', "bad_record.record_id.zero_uuid"),
        (line(entity_id="x"), "bad_record.entity_id.invalid.bad_uuid"),
        (json.dumps({"id": U}), "bad_record.missing_timestamp"),
        (json.dumps({"id": U, "timestamp": None, "time": 1715316569}), "bad_record.missing_timestamp"),
        (json.dumps({"id": U, "time": 17}), "invalid_timestamp"),
        (line(supersedes_id="q"), "bad_record.invalid_supersedes_id"),
        (line(locked_until="q"), "bad_record.invalid_locked_until"),
    ],
)
def test_record_errors(text, error):
    with pytest.raises(EngineError) as e:
        parse_record(text)
    assert e.value.error_id == error


def test_metadata():
    r = parse_record(json.dumps({"id": U.upper().replace("-", ""), "entity_uuid": "{" + U + "}", "time": "2024-05-10T04:49:29Z", "supersedes_id": 5, "locked_until": 5, "_deletion_marker": False}))
    assert (r["record_id"], r["explicit_entity_id"], r["record_micros"], r["supersedes_id"], r["lock_micros"], r["is_deletion_marker"]) == (U, U, BASE * 10**6, None, None, True)
    assert normal_uuid("urn:uuid:" + U) == U and normal_uuid(U + "0") is None
    a, b = parse_record(line(x=1)), parse_record(json.dumps({"uuid": U[::-1].replace("-", "")[:32].ljust(32, "a"), "timestamp": 1715316570, "x": 1}))
    assert a["content_hash"] == b["content_hash"] and a["record_hash"] != b["record_hash"]


def test_parse_lines(spark):
    rows = parse_lines(spark.createDataFrame([(0, None), (1, " " + line(a=[1, 1]) + " "), (2, "{")], "index long, line string"), "ns").orderBy("index").collect()
    assert [r.error_id for r in rows] == ["bad_record.invalid_json", None, "bad_record.invalid_json"]
    assert rows[1].record_data == json.dumps({"a": [1, 1], "id": U, "time": 1715316569}, separators=(",", ":")) and len(rows[1].entries) == 5
    assert Limits().query_rows == 1000
