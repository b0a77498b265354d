"""End-to-end scenarios on small stores, in both semantics."""

import json
import time
import uuid
from collections import Counter

import pytest

from stratadoc.api import Engine
from stratadoc.config import Access, Client, Config
from stratadoc.errors import EngineError

T0 = 1_700_000_000


def new_id():
    return str(uuid.uuid4())


def doc(**more):
    return {"id": new_id(), "timestamp": T0, **more}


@pytest.fixture
def make(spark, tmp_path):
    def engine(semantics="reference", namespaces=("main", "other")):
        return Engine(spark, f"file://{tmp_path}/{semantics}-{new_id()}", Config(namespaces=namespaces, semantics=semantics))

    return engine


def post(e, docs, ns="main"):
    return e.write_jsonl(ns, "\n".join(json.dumps(d) for d in docs))


def names(e, request, ns="main"):
    return Counter(r["record"].get("name") for r in e.records_response(ns, request)["records"])


FIVE = [
    ("r_ab", {"t": ["a", "b"]}),
    ("r_none", {}),
    ("r_null", {"x": None}),
    ("r_b", {"t": ["b"], "x": 1}),
    ("r_aa", {"t": ["a", "a"]}),
]

EVERY = Counter(n for n, _ in FIVE)
TABLE = [
    ({"raw": {"filter": {"fields_present": [".t[]"]}}}, {"r_ab": 2, "r_b": 1, "r_aa": 2}, {"r_ab": 1, "r_b": 1, "r_aa": 1}),
    ({"filter": {"x": None}}, {"r_b": 1}, {"r_b": 1}),
    ({"filter": {"x": None}, "treat_nulls_as_absent": False}, {"r_null": 1, "r_b": 1}, {"r_null": 1, "r_b": 1}),
    ({"filter": {"t": ["a", "b"]}}, {}, {"r_ab": 1}),
    ({"filter": {"t": ["a"]}}, {"r_ab": 1, "r_aa": 2}, {"r_ab": 1, "r_aa": 1}),
    ({"exclude": {"x": None}}, {"r_null": 1}, {"r_ab": 1, "r_none": 1, "r_null": 1, "r_aa": 1}),
    ({"exclude": {"x": None}, "treat_nulls_as_absent": False}, {}, {"r_ab": 1, "r_none": 1, "r_aa": 1}),
    ({"exclude": {"zzz": None}, "treat_nulls_as_absent": False}, EVERY, EVERY),
    ({"exclude": {"zzz": None}}, {}, EVERY),
    ({"exclude": {"t": ["a"]}}, {"r_ab": 1, "r_none": 1, "r_null": 1, "r_b": 1}, {"r_none": 1, "r_null": 1, "r_b": 1}),
    ({"filter": {"x": "*"}, "wildcard": "*"}, {"r_b": 1}, {"r_b": 1}),
    ({"filter": {"t": ["a"]}, "exclude": {"t": ["b"]}}, {"r_ab": 1, "r_aa": 2}, {"r_aa": 1}),
    ({"filter": {"t": ["a"]}, "exclude": {"t": [None]}}, {}, {}),
    ({"filter": {"t": []}}, EVERY, EVERY),
    ({"raw": {"filter": {"field_values": {".x": ["1"]}}}}, {"r_b": 1}, {"r_b": 1}),
    ({"exclude": {"x": 1, "name": "r_ab"}}, {"r_none": 1, "r_null": 1, "r_aa": 1}, {"r_none": 1, "r_null": 1, "r_aa": 1}),
]


@pytest.fixture(scope="module")
def five(spark, tmp_path_factory):
    out = {}
    for semantics in ("reference", "intended"):
        e = Engine(spark, f"file://{tmp_path_factory.mktemp('five')}/s", Config(semantics=semantics))
        post(e, [{"id": new_id(), "timestamp": T0 + i, "name": n, **d} for i, (n, d) in enumerate(FIVE)])
        out[semantics] = e
    return out


@pytest.mark.parametrize("k", range(len(TABLE)))
def test_predicates(five, k):
    request, reference, intended = TABLE[k]
    assert names(five["reference"], request) == Counter(reference)
    assert names(five["intended"], request) == Counter(intended)


def test_orders_limits_and_times(five):
    e = five["reference"]
    got = lambda **q: [r["record"]["name"] for r in e.records_response("main", q)["records"]]
    assert got() == [n for n, _ in FIVE] and got(order_by="-time", limit=2) == ["r_aa", "r_b"]
    assert got(timestamp_start=T0 + 1, timestamp_end=T0 + 3) == ["r_none", "r_null"]
    assert got(timestamp_start="2023-11-14T22:13:24Z") == ["r_aa"] and len(got(limit=0)) == 5
    ids = [r["record_id"] for r in e.records_response("main", {"order_by": "-id"})["records"]]
    assert ids == sorted(ids, reverse=True) and len(got(order_by="random", limit=3)) == 3


def test_fields_and_values(five):
    e = five["reference"]
    fields = {f["field"]: f["count"] for f in e.fields_response("main", {})["fields"]}
    assert fields == {"id": 5, "timestamp": 5, "name": 5, "t": 3, "t[]": 5, "x": 2}
    assert [f["field"] for f in e.fields_response("main", {})["fields"]][:4] == ["id", "name", "t[]", "timestamp"]
    assert e.fields_response("main", {"filter": {"name": "nobody"}}) == {"fields": None}
    assert e.values_response("main", "t[]", {}) == {"fields": [{"field": "t[]", "count": 5, "values": [{"value": "a", "count": 3}, {"value": "b", "count": 2}]}]}
    assert e.values_response("main", ["x", "gone"], {"filter": {"name": "r_b"}}) == {"fields": [{"field": "x", "count": 1, "values": [{"value": 1, "count": 1}]}, {"field": "gone", "count": 0, "values": []}]}
    with pytest.raises(Exception, match="null_value"):
        e.values_response("main", "t", {})
    assert five["intended"].values_response("main", "t", {})["fields"][0]["count"] == 0
    assert five["intended"].fields_response("main", {"limit": 1}) == {"fields": [{"field": "id", "count": 5, "values": None}]}


def test_requests_are_strict(five):
    e = five["reference"]
    for body in ('{"filters":{}}', '{"order_by":""}', '{"order_by":"name"}', '{"limit":"x"}', '{"filter":3}', "{", '{"raw":{"filter":{"x":1}}}'):
        status, out = e.call("POST", "/api/query/main/records/", body)
        assert status == 400 and out["error"]["data"]["id"] == "bad_request.invalid_request", body
    assert e.call("POST", "/api/query/main/records/", '{"FILTER":null,"timestamp_start":"x"}')[0] == 400
    assert e.call("POST", "/api/query/main/records/", '{"Limit":1}')[0] == 200
    assert e.call("POST", "/api/query/main/records/", '{"omit_locked":true}')[0] == 500
    assert e.call("GET", "/api/nothing")[0] == 404 and e.call("POST", "/api/query/nowhere/records/", "{}")[0] == 400


def test_jsonl_with_bad_lines(make):
    e = make()
    a, b, c = doc(), doc(), doc()
    body = "\n".join(["", *map(json.dumps, (a, b, c)), "\t"])
    out = e.write_jsonl("main", body)
    assert out["stats"] == {"num_records": 5, "num_ok": 3, "num_already_present": 0, "num_inserted": 3, "num_error": 2} and not out["all_ok"]
    assert out["item_status"] == [{"index": 0, "count": 1, "ok": False, "error": "bad_record.invalid_json"}, {"index": 1, "count": 3, "ok": True, "first_uuid": a["id"]}, {"index": 4, "count": 1, "ok": False, "error": "bad_record.invalid_json"}]
    again = e.write_jsonl("main", body)["stats"]
    assert (again["num_already_present"], again["num_inserted"], again["num_ok"]) == (3, 0, 3)
    changed = post(e, [{**a, "x": 1}])
    assert changed["item_status"] == [{"index": 0, "count": 1, "ok": False, "error": "bad_record.reusing_id"}]


def test_lookups(make):
    e = make()
    a, b, c = doc(u="one"), doc(u="two"), doc(u="two", arr=["v", "v"])
    post(e, [a, b, c])
    assert e.record("main", a["id"].upper())["record"] == a and e.by_field("main", "u", "one")["record_id"] == a["id"]
    for field, value, error in (("u", "two", "lookup_error.multiple_records"), ("u", "none", "not_found.record"), ("arr[]", "v", "lookup_error.multiple_records")):
        with pytest.raises(EngineError) as x:
            e.by_field("main", field, value)
        assert x.value.error_id == error and x.value.status == 404
    assert e.call("GET", f"/api/query/main/records/{new_id()}/")[0] == 404 and e.call("GET", "/api/query/main/records/x/")[0] == 400 and e.call("GET", "/api/query/main/entities/x/")[0] == 400
    assert e.call("GET", f"/api/query/other/records/{a['id']}/")[0] == 404


def test_superseding_and_entities(make):
    e = make()
    a = doc(v=1)
    e.write_record("main", json.dumps(a))
    b = doc(v=2, supersedes_id=a["id"])
    e.write_record("main", json.dumps(b))
    assert [r["record"]["v"] for r in e.records_response("main", {})["records"]] == [2]
    assert len(e.records_response("main", {"omit_superseded": False})["records"]) == 2
    assert e.entity("main", a["id"])["record_id"] == b["id"] and e.record("main", b["id"])["entity_id"] == a["id"] and e.record("main", a["id"])["record_id"] == a["id"]
    for bad, error in (
        (doc(supersedes_id=new_id()), "bad_request.cannot_supersede_nonexistent"),
        (doc(supersedes_id=a["id"]), "bad_request.already_superseded"),
        (doc(supersedes_id=b["id"], entity_id=new_id()), "bad_record.superseded_entity_id_mismatch"),
    ):
        with pytest.raises(EngineError) as x:
            e.write_record("main", json.dumps(bad))
        assert x.value.error_id == error
    with pytest.raises(EngineError) as x:
        post(e, [doc(supersedes_id=b["id"]), doc(supersedes_id=b["id"])])
    assert x.value.error_id == "bad_request.duplicate_supersedes"
    with pytest.raises(EngineError) as x:
        post(e, [doc(supersedes_id=new_id())])
    assert x.value.error_id == "internal_error.superseded_record_not_found"
    from stratadoc.operators.ingest import hide, override

    c = override(e.store, "main", b["id"], e.record("main", b["id"]))
    assert [r["record"]["v"] for r in e.records_response("main", {})["records"]] == [2]
    hide(e.store, "main", c["uuid"])
    assert e.records_response("main", {}) == {"records": []} and len(e.records_response("main", {"omit_hidden": False})["records"]) == 1


def test_superseding_within_a_call(make):
    a = doc()
    b = doc(supersedes_id=a["id"], entity_id=a["id"])
    for semantics, n in (("reference", 2), ("intended", 1)):
        e = make(semantics)
        if semantics == "intended":
            post(e, [a])
            post(e, [b])
        else:
            post(e, [a, b])
        assert len(e.records_response("main", {})["records"]) == n


def test_repeated_ids(make):
    a = doc()
    with pytest.raises(EngineError) as x:
        post(make(), [a, a])
    assert x.value.error_id == "internal_error.duplicate_id"
    e = make("intended")
    out = post(e, [a, a, {**a, "x": 1}])["stats"]
    assert (out["num_inserted"], out["num_already_present"], out["num_error"]) == (1, 1, 1)
    e = make()
    post(e, [a])
    with pytest.raises(EngineError):
        post(e, [a], "other")
    e = make("intended")
    post(e, [a])
    assert post(e, [a], "other")["all_ok"]
    b = doc(entity_id=a["id"])
    with pytest.raises(EngineError) as x:
        post(e, [b])
    assert x.value.error_id == "bad_record.entity_has_active_record" and x.value.status == 409


def test_upsert(make):
    e, entity = make(), new_id()
    first = doc(entity_id=entity, message="m")
    status, out = e.upsert("main", json.dumps(first))
    assert status == 201 and out == {"entity_id": entity, "record_id": first["id"], "superseded_record_id": "00000000-0000-0000-0000-000000000000", "created": True, "updated": True}
    assert e.upsert("main", json.dumps({**first, "id": new_id(), "timestamp": T0 + 5}))[0] == 200
    assert e.entity("main", entity)["record_id"] == first["id"]
    second = doc(entity_id=entity, message="n")
    status, out = e.upsert("main", json.dumps(second))
    assert status == 201 and out["superseded_record_id"] == first["id"] and not out["created"]
    assert e.entity("main", entity)["record"]["message"] == "n"
    for bad, error in ((doc(message="x"), "bad_request.upsert.missing_entity_id"), ({**doc(entity_id=entity), "timestamp": T0 - 1}, "bad_request.upsert_timestamp_back"), (doc(entity_id=entity, supersedes_id=first["id"]), "bad_request.supersede_mismatch")):
        status, out = e.call("POST", "/api/ingest/main/upsert/", json.dumps(bad))
        assert status == 400 and out["error"]["data"]["id"] == error


def test_batches(make):
    e = make()
    assert e.call("GET", "/api/ingest/main/batches/b1/")[0] == 404
    assert e.call("POST", "/api/ingest/main/batches/b1/jsonl/", json.dumps(doc()))[0] == 200
    assert e.call("GET", "/api/ingest/main/batches/b1/")[0] == 200 and e.call("GET", "/api/ingest/other/batches/b1/")[0] == 404
    out = e.check_batches("main", {"batch_names": ["b2", "b1", "b2"]})
    assert [b["status"] for b in out["batches"]] == ["not_found", "processed", "not_found"]
    for body in ('{"batch_names":[]}', '{"names":["x"]}'):
        assert e.call("POST", "/api/ingest/main/batches/check/", body)[0] == 400


def test_locks_and_stats(make):
    e = make("intended")
    post(e, [doc(n=1), doc(n=2, locked_until="2030-01-01T00:00:00Z"), doc(n=3, locked_until="2020-01-01T00:00:00Z")])
    got = e.records("main", {"omit_locked": True}, now="2025-01-01 00:00:00").collect()
    assert sorted(json.loads(r.record_data)["n"] for r in got) == [1, 3]
    s = e.stats("main")
    assert s["records"] == 3 and s["index_rows"] == 11 and s["keys"] == 4 and s["expansion_factor"] > 0


def test_unmarked_commits_are_not_seen(make):
    e = make()
    post(e, [doc()])
    n = e.store.next_commit()
    from pyspark.sql import functions as F

    e.store.append(n, "field_keys", e.spark.range(1).select(F.lit("main").alias("namespace"), F.lit(".half").alias("key_name")))
    assert e.store.read("field_keys").where("key_name = '.half'").count() == 0


def test_config():
    with pytest.raises(ValueError):
        Client("alice", "short")
    c = Config(clients=(Client("alice", "s" * 70, {"main": Access(query=True)}),))
    assert c.authorize("alice", "s" * 70, "main", "query") and not c.authorize("alice", "s" * 70, "main", "ingest") and not c.authorize("bob", "", "main", "query")


def test_sync_of_a_growing_directory(make, tmp_path):
    from stratadoc.streaming.sync import stream_lines, sync_directory, watch_directory

    e, folder = make(), tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    rows = [doc(n=i) for i in range(6)]
    text = lambda part: "\n".join(map(json.dumps, part)) + "\n"
    (folder / "deep" / "a.jsonl").write_text(text(rows[:2]))
    (folder / "b.jsonl.tmp").write_text(text(rows[5:]))
    assert sync_directory(e.store, "main", f"file://{folder}").summary()["num_inserted"] == 2
    assert sync_directory(e.store, "main", f"file://{folder}") is None
    (folder / "deep" / "a.jsonl").write_text(text(rows[:4]))
    grown = sync_directory(e.store, "main", f"file://{folder}").summary()
    assert (grown["num_inserted"], grown["num_already_present"]) == (2, 2)
    (folder / "copy.jsonlines").write_text(text(rows[:4]))
    assert sync_directory(e.store, "main", f"file://{folder}").summary()["num_records"] == 0
    (folder / "c.jsonl").write_text(text(rows[4:5]))
    q = watch_directory(e.store, "main", f"file://{folder}", f"file://{tmp_path}/cp", seconds=1)
    deadline = time.time() + 60
    while len(e.store.commits()) < 4 and time.time() < deadline:
        time.sleep(0.5)
    q.stop()
    assert len(e.records_response("main", {})["records"]) == 5
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.txt").write_text(text(rows[5:]))
    lines = e.spark.readStream.text(f"file://{tmp_path}/lines").withColumnRenamed("value", "line")
    for _ in range(2):
        stream_lines(e.store, "main", lines, f"file://{tmp_path}/cp2", "s").awaitTermination()
    assert len(e.records_response("main", {})["records"]) == 6


def test_batches_of_lines():
    from stratadoc.sources.jsonl import batch_digest, batches_of, body_lines

    assert list(batches_of(iter(["a", " ", "bb", "ccc"]), 4)) == [(["a", "bb"], False), (["ccc"], True)]
    assert list(batches_of(iter([]), 4)) == [([], True)] and len(batch_digest(["a"])) == 64
    assert body_lines("a\r\n\nb\n") == ["a", "", "b"] and body_lines("a\n" + "x" * (1 << 20 | 1) + "\nb") == ["a"]


def test_command_line(make, capsys):
    from stratadoc.cli import parser, run

    e = make()
    out = lambda *a: list(run(e, parser().parse_args(["--root", "x", *a])))
    rid = json.loads(out("put", '{"tag":["a","a"]}')[0])["uuid"]
    assert out("list") == [rid] and json.loads(out("get", rid)[0])["record"]["tag"] == ["a", "a"]
    assert json.loads(out("get", rid, "--field", "Entity-ID")[0])["record_id"] == rid
    assert "2\ttag[]" in out("fields") and out("values", "tag[]") == ["2\ttag[]", '  2\t"a"'] and json.loads(out("query", '{"tag":["a"]}')[0])["record_id"] == rid
    out("override", rid, '{"tag":"b"}')
    assert out("list", '{"tag":"b"}') != [rid] and json.loads(out("stats")[0])["records"] == 2
