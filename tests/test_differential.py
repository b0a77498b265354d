"""Random queries against a plain model of the join semantics, in both modes."""

import json
import random
from collections import Counter

import pytest

from stratadoc.operators.flatten import field_index
from stratadoc.operators.metadata import parse_lines
from stratadoc.plans.planner import Collection, match
from stratadoc.plans.spec import compile_query

N = 60


def documents(rng):
    atoms = [None, True, 1, 2, 2.5, "a", "b", "x" * 1100, {}, []]
    out = []
    for i in range(N):
        d = {"id": f"00000000-0000-0000-0000-{i + 1:012d}", "time": 1_700_000_000 + i}
        for key in rng.sample("pqrs", rng.randrange(4)):
            d[key] = rng.choice([rng.choice(atoms), [rng.choice(atoms) for _ in range(rng.randrange(4))], {"k": rng.choice(atoms)}])
        out.append(d)
    return out


def random_query(rng):
    def tests():
        paths = [".p", ".q", ".r", ".s", ".p[]", ".q[]", ".r[]", ".p.k", ".q.k", ".gone"]
        values = ["null", "true", "1", "2", "2.5E0", '"a"', '"b"']
        present = rng.sample(paths, rng.choice([0, 0, 1]))
        return {"fields_present": present, "field_values": {p: rng.sample(values, rng.choice([1, 1, 2])) for p in rng.sample(paths, rng.choice([0, 1, 1, 2]))}}

    return {"raw": {"filter": tests() if rng.random() < 0.7 else None, "exclude": tests() if rng.random() < 0.7 else None}, "treat_nulls_as_absent": rng.random() < 0.5}


def model(index, q, semantics):
    """Record ids with their multiplicity; index: record id -> list of (path, value)."""
    treat = q.treat_nulls_as_absent
    shown = lambda v: v is None or v != "null" or not treat
    out = Counter()
    known = {p for rows in index.values() for p, _ in rows}
    for rid, rows in index.items():
        of = lambda path: [v for p, v in rows if p == path]
        if semantics == "intended":
            yes = all(any(shown(v) for v in of(p)) for p in q.filter.present) and all(t in of(p) for p, ts in q.filter.values.items() for t in ts)
            no = any(any(shown(v) for v in of(p)) for p in q.exclude.present) or any(t in of(p) for p, ts in q.exclude.values.items() for t in ts)
            out[rid] += yes and not no
            continue
        n = 1
        for path in q.filter.paths():
            keep = [v for v in of(path) if all(v == t for t in q.filter.values.get(path, [])) and (path not in q.filter.present or shown(v))]
            if path in q.exclude.present:
                keep = [v for v in keep if treat and v == "null"]
            n *= len([v for v in keep if all(v is None or v != t for t in q.exclude.values.get(path, []))])
        for path in (p for p in q.exclude.paths() if p not in q.filter.paths()):
            if path in q.exclude.present and not treat:
                if path in known:
                    n = 0
                if path not in q.exclude.values:
                    continue
            keep = [v for v in (of(path) or [None]) if all(v is None or v != t for t in q.exclude.values.get(path, []))]
            n *= len([v for v in keep if v == "null"] if path in q.exclude.present and treat else keep)
        out[rid] += n
    return +out


@pytest.mark.parametrize("semantics", ["reference", "intended"])
def test_random_queries(spark, semantics):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    docs = documents(rng)
    lines = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "index long, line string")
    parsed = parse_lines(lines, "main").cache()
    records = parsed.select("record_id", F.col("record_id").alias("entity_id"), "record_timestamp", "record_data", "locked_until", F.lit(False).alias("is_superseded"), "is_deletion_marker")
    rows = field_index(parsed).cache()
    c = Collection(spark, "main", records, rows, rows.select("key_name").distinct())
    index: dict = {r.record_id: [] for r in parsed.select("record_id").collect()}
    for r in rows.collect():
        index[r.record_id].append((r.key_name, r.value))
    asked = 0
    frames, wanted = [], Counter()
    for k in range(24):
        q = compile_query(random_query(rng), semantics=semantics)
        frames.append(match(c, q, semantics).select(F.lit(k).alias("k"), "record_id"))
        wanted.update({(k, rid): n for rid, n in model(index, q, semantics).items()})
        asked += 1
    got = Counter()
    for part in range(0, asked, 6):
        union = frames[part]
        for f in frames[part + 1 : part + 6]:
            union = union.unionAll(f)
        got.update((r.k, r.record_id) for r in union.collect())
    assert got == wanted and len(wanted) > 100
