"""Plans of the query shapes over a collection's records, field index and key dictionary.

Reference semantics keep the bag of a join per path: all tests of a path, of filters and of excludes, look at the same index row,
and a record comes once for every row that passes. Intended semantics use one semi or anti join per test.

Only slices of the index by path (and value) are joined, so the scan prunes files by namespace and row groups by
key; the sides are left to the optimizer, which broadcasts small slices by their measured size.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.errors import EngineError
from stratadoc.plans.spec import CompiledQuery

#: Versions of an entity that are looked up by their ids; beyond them, records are searched by entity.
MOST_VERSIONS = 1000
RECORD_COLUMNS = ("record_id", "entity_id", "record_timestamp", "record_data")


@dataclass
class Collection:
    """One namespace: records (with is_superseded), field index and key dictionary; and, of a store, the records without that
    flag, the versions of entities that have a name of their own, and the index rows by path."""

    spark: SparkSession
    namespace: str
    records: DataFrame
    index: DataFrame
    keys: DataFrame
    stored: DataFrame | None = None
    entities: DataFrame | None = None
    key_counts: DataFrame | None = None


def both(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def visible(c: Collection, q: CompiledQuery, semantics: str, now: object | None = None) -> DataFrame:
    """Records by flags and time."""
    r = c.records
    if q.omit_locked:
        if semantics == "reference":
            raise EngineError("internal_error.not_implemented", "omit_locked is not implemented")
        clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        r = r.where(F.col("locked_until").isNull() | (F.col("locked_until") <= clock))
    if q.omit_superseded:
        r = r.where(~F.col("is_superseded"))
    if q.omit_hidden:
        r = r.where(~F.col("is_deletion_marker"))
    if q.start is not None:
        r = r.where(F.col("record_timestamp") >= F.timestamp_micros(F.lit(q.start)))
    if q.end is not None:
        r = r.where(F.col("record_timestamp") < F.timestamp_micros(F.lit(q.end)))
    return r


def slice_of(c: Collection, path: str, *tests: Column, columns: tuple[str, ...] = ("record_id", "value")) -> DataFrame:
    return c.index.where((F.col("key_name") == path) & both(list(tests))).select(*columns)


def not_null_value(treat_nulls_as_absent: bool) -> Column:
    """What presence asks of a row: any row, or any but a literal null."""
    v = F.col("value")
    return (v.isNull() | (v != "null")) if treat_nulls_as_absent else F.lit(True)


def match(c: Collection, q: CompiledQuery, semantics: str = "reference", now: object | None = None) -> DataFrame:
    """The matching records; in reference semantics with their multiplicity."""
    r = visible(c, q, semantics, now)
    if semantics == "intended":
        return match_sets(c, r, q)
    v, filters, excludes = F.col("value"), q.filter, q.exclude
    for path in filters.paths():
        tests = [v == text for text in filters.values.get(path, [])]
        if path in filters.present:
            tests.append(not_null_value(q.treat_nulls_as_absent))
        if path in excludes.present:  # on the row that is there: never absent
            tests.append(v == "null" if q.treat_nulls_as_absent else F.lit(False))
        tests += [v.isNull() | (v != text) for text in excludes.values.get(path, [])]
        r = r.join(slice_of(c, path, *tests, columns=("record_id",)), "record_id")
    for path in (p for p in excludes.paths() if p not in filters.paths()):
        tests = [F.col("_value").isNull() | (F.col("_value") != text) for text in excludes.values.get(path, [])]
        if path in excludes.present:
            if q.treat_nulls_as_absent:
                tests.append(F.col("_value") == "null")
            else:  # whether the key is known at all in the namespace
                known = c.keys.where(F.col("key_name") == path).limit(1).agg(F.count(F.lit(1)).alias("_known"))
                r = r.join(F.broadcast(known), F.lit(True), "inner").where("_known = 0").drop("_known")
                if not excludes.values.get(path):
                    continue
        rows = slice_of(c, path).withColumnRenamed("value", "_value")
        r = r.join(rows, "record_id", "left").where(both(tests)).drop("_value")
    return r


def match_sets(c: Collection, r: DataFrame, q: CompiledQuery) -> DataFrame:
    v = F.col("value")
    present = not_null_value(q.treat_nulls_as_absent)
    for preds, how in ((q.filter, "left_semi"), (q.exclude, "left_anti")):
        for path in preds.present:
            r = r.join(slice_of(c, path, present, columns=("record_id",)), "record_id", how)
        for path, texts in preds.values.items():
            for text in texts:
                r = r.join(slice_of(c, path, v == text, columns=("record_id",)), "record_id", how)
    return r


def ordered(r: DataFrame, q: CompiledQuery) -> DataFrame:
    """By time or id, ties by id; or at random."""
    what, down = q.order
    if what == "random":
        return r.orderBy(F.rand())
    keys = ["record_timestamp", "record_id"] if what == "time" else ["record_id"]
    return r.orderBy(*(F.col(k).desc() if down else F.col(k) for k in keys))


def records_query(c: Collection, q: CompiledQuery, semantics: str = "reference", now: object | None = None, columns: tuple[str, ...] = RECORD_COLUMNS) -> DataFrame:
    """The matching records in order. They are found without their documents, which are joined to the result by id: a limited
    result is small, so the documents are not shuffled for it."""
    narrow = [x for x in RECORD_COLUMNS if x != "record_data"]
    r = ordered(match(c, q, semantics, now).select(*narrow), q)
    r = r.limit(q.limit) if q.limit > 0 else r
    if "record_data" not in columns:
        return r.select(*columns)
    if q.order[0] == "random":  # an order that a join would lose
        r = r.withColumn("_place", F.monotonically_increasing_id())
    documents = (c.records if c.stored is None else c.stored).select("record_id", "record_data")
    r = r.join(documents, "record_id")
    return (r.orderBy("_place") if q.order[0] == "random" else ordered(r, q)).select(*columns)


def lists_query(c: Collection, queries: list[CompiledQuery], semantics: str = "reference", now: object | None = None) -> DataFrame:
    """(query, record_id): the matching records of each query, by its place, and in its order. Queries that differ only in the values
    that they ask of the same paths are one plan, however many they are; others are a plan each."""
    first = queries[0]
    paths = list(first.filter.values)
    plain = paths and first.limit <= 0 and first.order[0] != "random" and all(len(q.filter.values[p]) == 1 for q in queries for p in q.filter.values)
    alike = lambda q: replace(q, filter=replace(q.filter, values=dict.fromkeys(sorted(q.filter.values))))
    if len(queries) == 1 or not plain or first.filter.present or first.exclude.paths() or any(alike(q) != alike(first) for q in queries):
        each = [records_query(c, q, semantics, now, columns=("record_id",)).select(F.lit(k).alias("query"), "record_id", F.monotonically_increasing_id().alias("_place")) for k, q in enumerate(queries)]
        return reduce(DataFrame.unionAll, each).orderBy("query", "_place").drop("_place")
    keys = [f"_text_{i}" for i in range(len(paths))]
    asked = [(k, *(q.filter.values[p][0] for p in paths)) for k, q in enumerate(queries)]
    wanted = c.spark.createDataFrame(asked, ", ".join(["query int", *(f"{key} string" for key in keys)]))
    r = visible(c, first, semantics, now).select("record_id", "record_timestamp")
    for i, (path, key) in enumerate(zip(paths, keys, strict=True)):
        texts = {row[i + 1] for row in asked}
        tests = [F.col("value") == next(iter(texts))] if len(texts) == 1 else []
        rows = slice_of(c, path, *tests).withColumnRenamed("value", key)
        if not tests:
            rows = rows.join(wanted.select(key).distinct(), key, "left_semi")
        r = r.join(rows.distinct() if semantics == "intended" else rows, "record_id")
    found = r.join(wanted, keys)
    what, down = first.order
    by = ["record_timestamp", "record_id"] if what == "time" else ["record_id"]
    return found.orderBy("query", *(F.col(k).desc() if down else F.col(k) for k in by)).select("query", "record_id")


def envelope(r: DataFrame, namespace: str) -> DataFrame:
    """The response form of records: RFC 3339 times, nanoseconds as text, and the document as a variant."""
    micros = F.unix_micros("record_timestamp")
    part = F.rtrim(F.lit("0"), F.date_format("record_timestamp", "SSSSSS"))
    time = F.concat(F.date_format("record_timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)), F.lit("Z"))
    return r.select(F.lit(namespace).alias("namespace"), "record_id", "entity_id", time.alias("timestamp"), F.concat(micros.cast("string"), F.lit("000")).alias("timestamp_unix_nano"), F.parse_json("record_data").alias("record"))


def display(key: Column | str) -> Column:
    """A path without its leading dot."""
    return F.regexp_replace(key, r"^\.", "")


def fields_query(c: Collection, q: CompiledQuery, semantics: str = "reference", limit: int = 1000, now: object | None = None) -> DataFrame:
    """(field, count) of the index rows of matching records, most first; the fixed limit, or the request's if intended."""
    limit = limit if semantics == "reference" else q.limit
    if c.key_counts is not None and not q.filter.paths() and not q.exclude.paths() and q.start is None and q.end is None and not q.omit_locked:
        # every record but those hidden or superseded: the stored counts less the index rows of these few
        out_of_sight = F.lit(False)
        if q.omit_superseded:
            out_of_sight = out_of_sight | F.col("is_superseded")
        if q.omit_hidden:
            out_of_sight = out_of_sight | F.col("is_deletion_marker")
        less = c.index.select("record_id", "key_name").join(c.records.where(out_of_sight).select("record_id"), "record_id", "left_semi")
        less = less.groupBy("key_name").agg((-F.count(F.lit(1))).alias("n"))
        out = c.key_counts.select("key_name", "n").unionByName(less).groupBy("key_name").agg(F.sum("n").alias("count")).where("count > 0")
    else:
        rows = match(c, q, semantics, now).select("record_id").join(c.index.select("record_id", "key_name"), "record_id")
        out = rows.groupBy("key_name").agg(F.count(F.lit(1)).alias("count"))
    out = out.orderBy(F.desc("count"), "key_name")
    out = out.limit(limit) if limit > 0 else out
    return out.select(display("key_name").alias("field"), "count")


def value_rows(c: Collection, q: CompiledQuery, fields: list[str], semantics: str = "reference", limit: int = 1000, now: object | None = None) -> DataFrame:
    """(key_name, value, count) over at most `limit` matching rows, the first by time and id."""
    limit = limit if semantics == "reference" else q.limit
    ids = match(c, q, semantics, now).select("record_id", "record_timestamp")
    if limit > 0:
        ids = ids.orderBy("record_timestamp", "record_id").limit(limit)
    rows = c.index.where(F.col("key_name").isin([f".{f}" for f in fields])).join(ids.select("record_id"), "record_id", "left_semi")
    if semantics == "intended":
        rows = rows.where(F.col("value").isNotNull())
    return rows.groupBy("key_name", "value").agg(F.count(F.lit(1)).alias("count"))


def no_nulls(rows: DataFrame) -> DataFrame:
    """In reference semantics an object, array or overlong value among the values fails the call."""
    message = F.lit("internal_error.null_value")
    return rows.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("value")))


def values_query(c: Collection, q: CompiledQuery, fields: list[str], semantics: str = "reference", limit: int = 1000, now: object | None = None) -> DataFrame:
    """(field, count, values: array of (value, count) by value), one row per requested field, absent ones with zero."""
    if not fields:
        raise EngineError("bad_request.missing_field_name", "a field name is needed")
    rows = value_rows(c, q, fields, semantics, limit, now)
    if semantics == "reference":
        rows = no_nulls(rows)
    grouped = rows.groupBy("key_name").agg(F.sum("count").alias("count"), F.array_sort(F.collect_list(F.struct("value", "count"))).alias("values"))
    wanted = c.spark.createDataFrame([(i, f".{f}") for i, f in enumerate(dict.fromkeys(fields))], "place int, key_name string")
    none = F.array().cast("array<struct<value:string,count:bigint>>")
    out = wanted.join(grouped, "key_name", "left")
    found = F.when(F.col("count").isNull(), 1).otherwise(0)
    out = out.orderBy(found, F.when(found == 0, F.col("key_name")), "place")
    return out.select(display("key_name").alias("field"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("values", none).alias("values"))


# --- lookups -------------------------------------------------------------------------------------------


def lookup_record(c: Collection, record_id: str) -> DataFrame:
    """A record by id, whatever its flags; files are clustered by it."""
    return (c.records if c.stored is None else c.stored).where(F.col("record_id") == record_id).select(*RECORD_COLUMNS)


def lookup_entity(c: Collection, entity_id: str) -> DataFrame:
    """An entity's active record: the latest, if there should be several.

    Its versions' ids come from the table of entities, which is clustered by entity, and from the record of the same name; the
    few that there are are then looked up by id.
    """
    wanted = F.col("entity_id") == entity_id
    records = c.records
    if c.entities is not None:
        ids = [r.record_id for r in c.entities.where(wanted).select("record_id").limit(MOST_VERSIONS + 1).collect()]
        if len(ids) <= MOST_VERSIONS:  # more would not be a lookup by id any more
            records = records.where(F.col("record_id").isin([entity_id, *ids]))
    active = records.where(wanted & ~F.col("is_superseded") & ~F.col("is_deletion_marker"))
    return active.orderBy(F.desc("record_timestamp"), F.desc("record_id")).limit(1).select(*RECORD_COLUMNS)


def lookup_field(c: Collection, name: str, canonical: str) -> DataFrame:
    """At most two index rows' active records with that value: one row means a unique answer."""
    active = c.records.where(~F.col("is_superseded") & ~F.col("is_deletion_marker"))
    return active.join(slice_of(c, f".{name}", F.col("value") == canonical, columns=("record_id",)), "record_id").select(*RECORD_COLUMNS).orderBy("record_id").limit(2)


def check_batches(ledger: DataFrame, namespace: str, names: list[str], spark: SparkSession) -> DataFrame:
    """(place, batch_name, processed) in the order asked."""
    if not names:
        raise EngineError("bad_request.no_batches", "no batch names")
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, batch_name string")
    known = ledger.where(F.col("namespace") == namespace).select("batch_name").distinct().withColumn("known", F.lit(True))
    return asked.join(known, "batch_name", "left").select("place", "batch_name", F.coalesce("known", F.lit(False)).alias("processed")).orderBy("place")


def stats(c: Collection) -> DataFrame:
    """One row of totals and of the figures derived from them."""
    r = c.records.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.length("record_data")), F.lit(0)).alias("record_chars"), F.max(F.length("record_data")).alias("longest_record"))
    k = c.keys.agg(F.count(F.lit(1)).alias("keys"))
    i = c.index.agg(F.count(F.lit(1)).alias("index_rows"))
    one = r.crossJoin(k).crossJoin(i)  # single rows
    return one.select("*", (F.col("record_chars") / F.col("records")).alias("mean_record_chars"), (F.col("index_rows") / F.col("records")).alias("index_rows_per_record"))
