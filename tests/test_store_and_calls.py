"""Store layout, compaction, access, transport, directory sync with a refused batch, and bulk upserts against single ones."""

import base64
import json
import random
import threading
import urllib.error
import urllib.request
import uuid

import pytest

from stratadoc.api import Engine
from stratadoc.config import Access, Client, Config, Limits
from stratadoc.errors import EngineError

T0 = 1_700_000_000
SECRET = "k" * 64


def doc(**more):
    return {"id": str(uuid.uuid4()), "timestamp": T0, **more}


def post(e, docs, ns="main"):
    return e.write_jsonl(ns, "\n".join(json.dumps(d) for d in docs))


@pytest.fixture
def make(spark, tmp_path):
    return lambda semantics="reference", **more: Engine(spark, f"file://{tmp_path}/{uuid.uuid4()}", Config(semantics=semantics, **more))


def login(name, secret=SECRET, host="h"):
    return {"Host": host, "Authorization": "Basic " + base64.b64encode(f"{name}:{secret}".encode()).decode()}


def test_access(make):
    clients = (Client("reader", SECRET, {"main": Access(query=True)}), Client("writer", SECRET, {"main": Access(ingest=True)}))
    e = make(clients=clients, accept_host="h", limits=Limits(refusal_seconds=0.05))
    read, write = ("POST", "/api/query/main/records/", "{}"), ("POST", "/api/ingest/main/record/", json.dumps(doc()))
    assert e.call(*read, login("reader"))[0] == 200 and e.call(*write, login("writer"))[0] == 200
    for request, headers in ((read, None), (read, {}), (read, login("writer")), (write, login("reader")), (read, login("reader", "x")), (read, login("nobody")), (read, login("reader", host="other")), (read, {"Host": "h", "Authorization": "Basic !"}), (read, {"Host": "h", "Authorization": "Bearer " + SECRET})):
        assert e.call(*request, headers) == (401, {"error": "Unauthorized"})
    assert e.call("POST", "/api/query/other/records/", "{}", login("reader"))[0] == 401


def test_refusals_take_their_time(make):
    import time

    e = make(clients=(Client("a", SECRET, {}),), limits=Limits(refusal_seconds=0.3))
    began = time.monotonic()
    assert e.call("POST", "/api/query/main/records/", "{}")[0] == 401 and time.monotonic() - began >= 0.3


def test_http(make):
    from stratadoc.server import make_server

    e = make(clients=(Client("a", SECRET, {"main": Access(True, True)}),), limits=Limits(refusal_seconds=0.0))
    server = make_server(e, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def send(path, body=None, headers=login("a")):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", body and body.encode(), {k: v for k, v in headers.items() if k != "Host"})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as x:
            return x.code, json.loads(x.read())

    d = doc(name="é b")
    assert send("/api/ingest/main/record/", json.dumps(d))[0] == 200
    assert send("/api/query/main/records/by/name/%C3%A9%20b/")[1]["record"] == d
    assert send("/api/query/main/records/", "{}", {})[0] == 401 and send("/api/nothing")[0] == 404
    server.shutdown()


def test_bodies(make):
    long = json.dumps(doc(x="y" * (1 << 20)))
    e = make()
    d = doc()
    assert e.call("POST", "/api/ingest/main/record/", json.dumps(d) + ' {"more": ')[0] == 200
    assert e.call("POST", "/api/query/main/records/", '{"limit":1} trailing')[0] == 200
    assert post_lines(e, [json.dumps(doc()), long, json.dumps(doc())])["stats"]["num_records"] == 1
    i = make("intended")
    out = post_lines(i, [json.dumps(doc()), long, json.dumps(doc())])
    assert out["stats"]["num_inserted"] == 2 and out["item_status"][1] == {"index": 1, "count": 1, "ok": False, "error": "bad_record.too_long"}
    assert i.call("POST", "/api/ingest/main/record/", json.dumps(d) + " x")[0] == 400


def post_lines(e, lines):
    return e.write_jsonl("main", "\n".join(lines))


def test_timestamps_are_ascii_and_whole():
    from stratadoc.functions.timestamps import interpret

    for bad in ("2023-11-14T22:13:20Z\n", "1700000000\n", "١٧٠٠٠٠٠٠٠٠", "२०२३-11-14T22:13:20Z"):
        with pytest.raises(EngineError):
            interpret(bad)
    assert interpret("1700000000") == T0 * 1_000_000


def test_layout_version(make, spark):
    e = make()
    system = e.store.filesystem()
    system.delete(e.store.path("_version.json"), False)
    e.store._write_text("_version.json", json.dumps({"version": 1}))
    with pytest.raises(ValueError, match="layout version 1"):
        Engine(spark, e.store.root)


def test_compaction_changes_nothing_that_is_read(make):
    e = make()
    a, b, c = doc(v=1, t=["x", "y"]), doc(v=2), doc(v=3)
    post(e, [a, b])
    e.write_record("main", json.dumps({**c, "supersedes_id": a["id"]}))
    seen = lambda: (e.records_response("main", {}), e.records_response("main", {"omit_superseded": False}), e.fields_response("main", {}), e.entity("main", a["id"]), e.record("main", a["id"]), e.stats("main")["records"])
    before = seen()
    assert e.store.compact() == 2 and seen() == before and e.store.clean() > 0 and seen() == before
    d = doc(v=4)
    post(e, [d])
    assert len(e.records_response("main", {})["records"]) == 3 and e.record("main", d["id"])["record"]["v"] == 4
    after = seen()
    assert e.store.compact() == 3 and e.store.clean() > 0 and seen() == after and e.store.compact() == 3
    from pyspark.sql import functions as F

    n = e.store.next_commit()
    e.store.append(n, "field_keys", e.spark.range(1).select(F.lit("main").alias("namespace"), F.lit(".half").alias("key_name")))
    assert e.store.clean() == 1


def test_lookups_read_by_id(make):
    """The plan of a lookup has its id in the scan's pushed filters, and the plan of a limited list does not shuffle documents."""
    from stratadoc.plans import planner
    from stratadoc.plans.spec import compile_query

    e = make()
    rows = [doc(n=i) for i in range(50)]
    post(e, rows)
    post(e, [doc(supersedes_id=rows[3]["id"], n=99)])
    c = e.store.collection("main")
    plan = planner.lookup_record(c, rows[0]["id"])._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(record_id,{rows[0]['id']})" in plan and "Exchange" not in plan
    plan = planner.lookup_entity(c, rows[3]["id"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(record_id" in plan.replace("in(record_id", "In(record_id")
    assert e.entity("main", rows[3]["id"])["record"]["n"] == 99
    plan = planner.records_query(c, compile_query({"limit": 5})).drop("record_data")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.index("GlobalLimit")
    assert "record_data" not in plan[top : plan.index("record_id#", top) + 4000].split("Relation")[0]


def test_sync_goes_on_past_a_refused_batch(make, tmp_path):
    from stratadoc.streaming.sync import sync_directory

    e = make(limits=Limits(sync_batch_bytes=400))
    folder = tmp_path / "in"
    folder.mkdir()
    fine = [doc(n=i, pad="p" * 60) for i in range(12)]
    first = doc(n="first")
    chain = [first, *[doc(n=f"c{i}", pad="p" * 60) for i in range(6)], doc(n="last", supersedes_id=first["id"])]
    twice = doc(n="poison")
    poison = [doc(n="before", pad="p" * 300), {**twice, "supersedes_id": fine[0]["id"]}, doc(supersedes_id=fine[0]["id"]), doc(n="after", pad="p" * 300)]
    write = lambda name, rows: (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    write("a.jsonl", fine)
    write("b.jsonl", chain)
    write("c.jsonl", poison)
    write("d.jsonl", [doc(n="z")])
    (folder / "e.jsonl.TMP").write_text("x")
    done = sync_directory(e.store, "main", f"file://{folder}")
    assert [(x["path"].rsplit("/", 1)[1], x["error_id"]) for x in done.errors] == [("c.jsonl", "bad_request.duplicate_supersedes")]
    names = {r["record"].get("n") for r in e.records_response("main", {})["records"]}
    assert names == {*range(12), *(f"c{i}" for i in range(6)), "last", "before", "after", "z"}  # `first` is superseded
    again = sync_directory(e.store, "main", f"file://{folder}")
    assert len(again.errors) == 1 and again.summary()["num_inserted"] == 0
    write("c.jsonl", [poison[0], poison[1], poison[3]])
    assert sync_directory(e.store, "main", f"file://{folder}").errors == [] and sync_directory(e.store, "main", f"file://{folder}") is None


def test_bulk_upserts_equal_single_ones(make):
    from stratadoc.operators.ingest import upsert_lines
    from stratadoc.sources.jsonl import lines_frame

    rng = random.Random(4)
    entities = [str(uuid.uuid4()) for _ in range(3)]
    rows = [doc(entity_id=rng.choice(entities), timestamp=T0 + k, m=rng.randrange(2)) for k in range(14)]
    single, bulk = make(), make()
    want = []
    for r in rows:
        _, out = single.upsert("main", json.dumps(r))
        want.append("created" if out["created"] else "updated" if out["updated"] else "unchanged")
    for part, expected in ((rows[:9], want[:9]), (rows[9:], want[9:])):
        status = upsert_lines(bulk.store, "main", lines_frame(bulk.spark, [json.dumps(r) for r in part])).status
        assert [r.outcome for r in status.orderBy("index").collect()] == expected
    active = lambda e: sorted((r["entity_id"], r["record"]["m"], r["timestamp"]) for r in e.records_response("main", {})["records"])
    assert active(single) == active(bulk)
    bad = [doc(m=1), {**doc(entity_id=entities[0]), "timestamp": T0 - 5}, doc(entity_id=entities[0], timestamp=T0 + 99, supersedes_id=str(uuid.uuid4())), "x"]
    status = upsert_lines(bulk.store, "main", lines_frame(bulk.spark, [json.dumps(b) for b in bad])).status
    assert [r.error_id for r in status.orderBy("index").collect()] == ["bad_request.upsert.missing_entity_id", "bad_request.upsert_timestamp_back", "bad_request.supersede_mismatch", "bad_record.not_an_object"]


def test_commands(make, capsys):
    from stratadoc.cli import parser, run

    e = make()
    out = lambda *a: list(run(e, parser().parse_args(["--root", "x", *a])))
    assert out("version")[0].startswith("stratadoc ") and all("missing" in x or "exists" in x for x in out("config"))
    out("put", '{"a":1}')
    assert json.loads("\n".join(out("compact")))["base"] == 1 and json.loads(out("stats")[0])["records"] == 1
