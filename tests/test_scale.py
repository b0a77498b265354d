"""Plans and steps that must not grow faster than their input."""

import re

import pytest

from stratadoc.plans import catalogue

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ingest_status_whole", "ingest_summary_whole", "ingest_ranges_whole", "entity_inheritance_whole"])
def test_calls_are_parsed_once_and_not_broadcast_by_guess(spark, name):
    """What is joined comes from files, whose sizes are known, not from parsed lines, whose size is underestimated."""
    text = plan(catalogue.queries()[name](spark, SF))
    assert "MapInArrow" not in text and "Scan parquet" in re.sub("FileScan", "Scan", text)


def test_a_list_of_many_queries_is_one_plan(spark, tmp_path):
    """The lists of all users at once agree with one list each, in both semantics, and take no job for each query."""
    import json
    import uuid

    from stratadoc.api import Engine
    from stratadoc.cli import list_lines, parser, run
    from stratadoc.config import Config

    for semantics in ("reference", "intended"):
        e = Engine(spark, f"file://{tmp_path}/{semantics}", Config(semantics=semantics))
        docs = [{"id": str(uuid.uuid4()), "time": 1_700_000_000 + i % 3, "kind": "ab"[i % 2], "user": [i % 3, i % 3 if i % 4 else 5]} for i in range(24)]
        e.write_jsonl("main", "\n".join(map(json.dumps, docs)))
        queries = [json.dumps({"filter": {"kind": "a", "user": [u]}, "limit": 0}) for u in (2, 5, 0, 9)]
        command = lambda *words: parser().parse_args(["--root", "x", *words])
        want = [x for q in queries for x in run(e, command("list", q))]
        assert want and list(run(e, command("list", *queries))) == want
        assert plan(list_lines(e, command("list", *queries))).count("field_index") == plan(list_lines(e, command("list", *queries[:2]))).count("field_index")
        mixed = [queries[0], '{"filter":{"kind":"b"},"limit":3}']
        assert list(run(e, command("list", *mixed))) == [x for q in mixed for x in run(e, command("list", q))]


def test_a_sync_takes_few_commits(spark, tmp_path):
    import json
    import uuid

    from stratadoc.config import Config, Limits
    from stratadoc.sources.store import Store
    from stratadoc.streaming.sync import sync_directory

    folder = tmp_path / "in"
    folder.mkdir()
    ids = [str(uuid.uuid4()) for _ in range(24)]
    (folder / "a.jsonl").write_text("".join(json.dumps({"id": i, "time": 1_700_000_000}) + "\n" for i in ids))
    store = Store(spark, f"file://{tmp_path}/store", Config(limits=Limits(sync_batch_bytes=100, sync_group_bytes=200)))
    assert sync_directory(store, "main", f"file://{folder}").summary()["num_inserted"] == 24
    assert store.read("synced_batches", "main").count() == 24 and len(store.commits()) < 8
    assert sorted(r.record_id for r in store.collection("main").records.collect()) == sorted(ids)


def test_a_call_shuffles_no_documents_and_no_index(spark, tmp_path):
    """Records and index rows are written from where they were parsed; a base deals the rows of one value by their ids."""
    import json
    import uuid

    from pyspark.sql import functions as F

    from stratadoc.operators.flatten import field_index
    from stratadoc.sources.jsonl import lines_frame
    from stratadoc.operators.metadata import parse_lines
    from stratadoc.sources.store import clustered, sorted_rows

    lines = lines_frame(spark, [json.dumps({"id": str(uuid.uuid4()), "time": 1_700_000_000, "same": "x"}) for _ in range(400)])
    index = field_index(parse_lines(lines, "main")).withColumn("namespace", F.lit("main"))
    assert "Exchange range" not in plan(sorted_rows("field_index", index))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same = clustered("field_index", index).where("key_name = '.same'")
        assert same.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def calls_of(spark, root, semantics):
    """Two calls of 60 lines; the second repeats ids of the first with and without a change, cuts lines, supersedes a record
    and, in intended semantics, repeats an id within itself. What is found of them afterwards."""
    import json
    import uuid

    from stratadoc.config import Config
    from stratadoc.operators.ingest import ingest_lines
    from stratadoc.sources.store import Store

    store = Store(spark, f"file://{root}", Config(semantics=semantics))
    name = lambda *of: str(uuid.uuid5(uuid.NAMESPACE_OID, repr(of)))
    doc = lambda i, **more: json.dumps({"id": name(i), "time": 1_700_000_000, "n": i, **more})
    lines = lambda texts: spark.createDataFrame([(i - 20 if i < 30 else i * 40_000, x) for i, x in enumerate(texts)], "index long, line string")
    first = ingest_lines(store, "main", lines([doc(i) for i in range(60)]))
    second = [doc(i, **({"changed": 1} if i % 4 == 0 else {})) for i in range(30)] + [doc(i) for i in range(100, 125)]
    second += [json.dumps({"id": name("new"), "time": 1_700_000_000, "supersedes_id": name(50)}), doc(7)[:9]]
    if semantics == "intended":
        second += [doc(110), doc(110, other=1)]
    result = ingest_lines(store, "main", lines(second))
    c = store.collection("main")
    rows = [first.status, result.status, c.records.drop("commit"), c.index.drop("commit"), c.key_counts.drop("commit").groupBy("key_name").sum("n"), c.entities.drop("commit")]
    return [sorted(map(repr, r.collect())) for r in rows]


@pytest.mark.parametrize("semantics", ["reference", "intended"])
def test_large_calls_give_what_small_ones_give(spark, tmp_path, monkeypatch, semantics):
    from stratadoc.operators import ingest

    want = calls_of(spark, tmp_path / "small", semantics)
    monkeypatch.setattr(ingest, "SMALL_CALL", 0)
    monkeypatch.setattr(ingest, "FEW_ODD", 0)
    assert calls_of(spark, tmp_path / "bitmaps", semantics) == want
    monkeypatch.setattr(ingest, "MOST_BITMAPS", 0)
    assert calls_of(spark, tmp_path / "merged", semantics) == want


def test_many_odd_records_shuffle_no_documents(spark, tmp_path, monkeypatch):
    """Records are left out where they were parsed; only those that inherit their entity are joined."""
    from stratadoc.operators import ingest
    from stratadoc.sources.store import Store

    monkeypatch.setattr(ingest, "FEW_ODD", 0)
    append, plans = Store.append, []

    def spy(self, commit, table, rows, *more):
        if table in ("records", "field_index"):
            plans.append(plan(rows))
        return append(self, commit, table, rows, *more)

    monkeypatch.setattr(Store, "append", spy)
    import json
    import uuid

    from stratadoc.sources.jsonl import lines_frame

    store = Store(spark, f"file://{tmp_path}/store")
    lines = [json.dumps({"id": str(uuid.uuid4()), "time": 1_700_000_000}) for _ in range(40)]
    for some in (lines[:20], lines):
        ingest.ingest_lines(store, "main", lines_frame(spark, some))
    assert len(plans) == 4 and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
    assert store.collection("main").records.count() == 40


def test_only_ids_that_meet_go_through_the_window(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from stratadoc.operators import ingest

    monkeypatch.setattr(ingest, "SMALL_CALL", 0)
    seen, classify = [], ingest.classify
    monkeypatch.setattr(ingest, "classify", lambda rows, *more: seen.append(rows.count()) or classify(rows, *more))
    ids = [f"id {i % 397}" for i in range(400)]
    none = {c: F.lit(None).cast("string") for c in ("error_id", "explicit_entity_id", "supersedes_id")}
    rows = spark.createDataFrame(list(enumerate(ids)), "index long, record_id string").withColumns({**none, "record_hash": F.col("record_id")})
    out = ingest.classify_call(rows, None, "reference", f"file://{tmp_path}/met")
    assert seen == [6]
    assert sorted(map(repr, out.select("index", "repeat", "inserted").collect())) == sorted(map(repr, classify(rows, None).select("index", "repeat", "inserted").collect()))
