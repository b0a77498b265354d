"""The whole-table queries on rows beyond the id prefixes of the queries they complete, against brute force."""

import hashlib
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest

from stratadoc.plans import catalogue

IDS = [*range(7), *range(4990, 5010), *range(100_000, 102_030), 1_000_000]
TYPES = "click", "view"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=i, microseconds=i % 1000), i % 5, TYPES[i % 2], 1.5, '{"k": 1}') for i in IDS]
    out = f"file://{tmp_path_factory.mktemp('events')}"
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{out}/events.parquet")
    return out


def run(spark, folder, name):
    return catalogue.queries()[name](spark, folder).collect()


def test_timestamps(spark, folder):
    got = {(r.unit, r.event_id): r.micros for r in run(spark, folder, "timestamp_interpret_whole")}
    start = int(datetime(2024, 1, 1, tzinfo=UTC).timestamp())
    assert got == {(u, i): (start + i) * 1_000_000 + (i % 1000 if u == "rfc" else 0) for i in IDS for u in ("number_s", "string_s", "string_ms", "rfc")}


def test_ingest(spark, folder):
    cut, clash = [i for i in IDS if i % 60 == 59], [i for i in IDS if i % 350 == 0]
    rows = run(spark, folder, "ingest_status_whole")
    assert sorted(r["index"] for r in rows) == IDS
    assert sorted(r["index"] for r in rows if not r.ok) == sorted(cut + clash)
    (total,) = run(spark, folder, "ingest_summary_whole")
    assert (total.num_records, total.num_error) == (len(IDS), len(cut) + len(clash))
    ranges = run(spark, folder, "ingest_ranges_whole")
    assert sum(r["count"] for r in ranges) == len(IDS) and {r.call for r in ranges} == {i // 2000 for i in IDS}


def test_batches_go_through_the_splitter(spark, folder):
    files = defaultdict(list)
    for i in IDS:
        files[TYPES[i % 2], i // 100_000].append(f'{{"seq":"{i:020d}"}}')
    want = set()
    for (kind, part), lines in files.items():
        for k in range(0, len(lines), 500):
            some = lines[k : k + 500]
            want.add((kind, part, k // 500, k + 500 >= len(lines), len(some), hashlib.sha256("\n".join(some).encode()).hexdigest()))
    assert {tuple(r) for r in run(spark, folder, "batch_digest_whole")} == want


def test_manifest(spark, folder):
    assert sorted(r["size"] for r in run(spark, folder, "manifest_delta_whole")) == [i for i in IDS if i % 2 or i % 6 == 0]


def uid(text):
    import uuid

    return str(uuid.UUID(hashlib.md5(text.encode()).hexdigest()))


def test_hashes_of_all_forms(spark, folder):
    import json

    want, shapes = {}, defaultdict(int)
    for i in IDS:
        time = datetime(2024, 1, 1) + timedelta(seconds=i, microseconds=i % 1000)
        doc = {"big": "x" * 1100} if i % 11 == 0 else {}
        doc |= {"even": None if i % 5 == 0 else i % 7} if i % 2 == 0 else {}
        doc |= {"record_id": uid(f"event:{i}"), "seq": i, "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S.%fZ")}
        want[doc["record_id"]] = hashlib.sha256(json.dumps(doc, separators=(",", ":")).encode()).hexdigest()
        shapes[hashlib.sha256("".join(f".{k}\n" for k in doc).encode()).hexdigest()] += 1
    assert {r.record_id: r.record_hash for r in run(spark, folder, "record_hash_whole")} == want
    assert {r.shape_hash: r.n for r in run(spark, folder, "shape_hash_whole")} == shapes


def test_every_version_inherits(spark, folder):
    want, seen = set(), defaultdict(int)
    for i in IDS:
        seen[i % 5] += 1
        want.add((uid(f"event:{i}"), uid(f"user:{i % 5}"), seen[i % 5]))
    assert {tuple(r) for r in run(spark, folder, "entity_inheritance_whole")} == want
