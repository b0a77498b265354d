"""Writing: JSONL ingestion with duplicate detection, superseding and entities; upserts, hiding and overriding.

A call is one commit: it is checked as a whole against the store and within itself, and then its records, index rows and keys
are appended, or nothing is. Every check is a join or an aggregate over the call's rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratadoc.errors import EngineError
from stratadoc.functions.canonical import canonical_json, first_json, parse_json
from stratadoc.operators.flatten import field_index
from stratadoc.operators.metadata import RECORD_ID_KEYS, TIMESTAMP_KEYS, ZERO_UUID, parse_lines
from stratadoc.sources.jsonl import lines_frame
from stratadoc.sources.store import Store


#: What a call's check looks at, of the parsed columns.
CLASSIFIED = ("index", "namespace", "error_id", "record_id", "explicit_entity_id", "record_timestamp", "record_hash", "supersedes_id", "is_deletion_marker")
#: So many odd records of a call are sent to all tasks; more are joined by a shuffle.
FEW_ODD = 100_000
#: So many bitmaps of 32,768 indexes, of 4 KiB each, are sent to all tasks.
MOST_BITMAPS = 4096
#: Staged bytes of a call whose rows all go through the window over their ids.
SMALL_CALL = 32 << 20
#: Staged bytes of a task that sorts records and their index rows, which are several times as large in memory.
TASK_BYTES = 32 << 20
STAGED = {"compression": "zstd"}


@contextmanager
def task_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Scans that run within this are cut into tasks of at most so many bytes, shuffles into tasks of about as many."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, str(most))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@dataclass
class IngestResult:
    """status: (index, record_id, ok, already_present, inserted, error_id) per item."""

    commit: int
    status: DataFrame

    def summary(self) -> dict:
        return summary(self.status).first().asDict()


def summary(status: DataFrame) -> DataFrame:
    """One row of counts over item statuses."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    total = F.count(F.lit(1))
    return status.agg(total.alias("num_records"), n("ok").alias("num_ok"), n("already_present").alias("num_already_present"), n("inserted").alias("num_inserted"), (total - n("ok")).alias("num_error"), (total == n("ok")).alias("all_ok"))


def status_ranges(status: DataFrame, *by: str) -> DataFrame:
    """Runs of consecutive items that are alike in (ok, error_id): index, count, ok, first_uuid, error_id.

    For the items of one request, whose number is limited, or of each request by the columns `by`; the window orders them all.
    """
    order = Window.partitionBy(*by).orderBy("index")
    new = ~(F.lag("ok").over(order).eqNullSafe(F.col("ok")) & F.lag("error_id").over(order).eqNullSafe(F.col("error_id")))
    runs = status.withColumn("_new", (new | (F.row_number().over(order) == 1)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    out = runs.groupBy(*by, "_run").agg(F.min("index").alias("index"), F.count(F.lit(1)).alias("count"), F.first("ok").alias("ok"), F.min_by("record_id", "index").alias("first_uuid"), F.first("error_id").alias("error_id"))
    return out.select(*by, "index", "count", "ok", F.when(F.col("ok"), F.col("first_uuid")).alias("first_uuid"), "error_id").orderBy("index")


def some(df: DataFrame) -> dict | None:
    row = df.first()
    return row.asDict() if row else None


def among(rows: DataFrame, indexes: DataFrame) -> DataFrame:
    """rows with `_among`: whether their index is one of `indexes`.

    The indexes of a call are mostly dense, so they are sent to the rows as bitmaps, a bit for each, and the rows stay where they
    are; indexes too far apart for that are joined by a shuffle.
    """
    bucket, at = F.bitmap_bucket_number("index"), F.bitmap_bit_position("index")
    if indexes.select(bucket).distinct().count() > MOST_BITMAPS:
        found = indexes.select("index").distinct().withColumn("_among", F.lit(True)).hint("merge")
        return rows.join(found, "index", "left").withColumn("_among", F.coalesce("_among", F.lit(False)))
    # dealt by bitmap first, as every task may hold some indexes of every bitmap
    dealt = indexes.select("index", bucket.alias("_bucket")).repartition("_bucket")
    bitmaps = dealt.groupBy("_bucket").agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    there = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("_bucket", bucket).join(F.broadcast(bitmaps), "_bucket", "left").withColumn("_among", there).drop("_bucket", "_bits")


def classify_call(parsed: DataFrame, stored: DataFrame | None, semantics: str, folder: str) -> DataFrame:
    """What `classify` gives; of a large call only those rows go through its joins and its window whose id may be stored or
    occur twice, by its hash, or that name a stored record. The others are known to be new."""
    if int(str(parsed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_CALL:
        return classify(parsed, stored, semantics)
    ids = parsed.where("record_id is not null").select("index", F.xxhash64("record_id").alias("_id"))
    if stored is not None:
        ids = ids.unionByName(stored.select(F.lit(None).cast("long").alias("index"), F.xxhash64("record_id").alias("_id")))
    met = ids.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_id"))).where("_n > 1 and index is not null").select("index")
    met.write.options(**STAGED).parquet(folder)
    rows = among(parsed, parsed.sparkSession.read.schema(met.schema).parquet(folder))
    meets = F.col("_among") | F.col("index").isNull()
    if stored is not None:
        meets = meets | F.col("supersedes_id").isNotNull()
    alone = rows.where(~meets).drop("_among").withColumns({c: F.lit(None).cast("string") for c in ("_hash", "_inherited")})
    return classify(rows.where(meets).drop("_among"), stored, semantics).unionByName(outcomes(alone, F.lit(1), F.col("record_hash")))


def classify(parsed: DataFrame, stored: DataFrame | None, semantics: str = "reference") -> DataFrame:
    """parsed with entity_id, `repeat` (place among equal ids of the call) and its outcome against the stored records, or
    within the call alone if there are none (None)."""
    # most rows supersede nothing and bad lines have no id: keys of their own keep them from meeting in one task
    own = F.concat(F.lit("line "), F.col("index").cast("string"))
    df = parsed.withColumn("_key", F.coalesce("record_id", own))
    if stored is None:
        none = F.lit(None).cast("string")
        df = df.withColumn("_hash", none).withColumn("_inherited", none)
    else:
        # of the stored records only those that the call names, without their documents
        named = parsed.select(F.explode(F.array("record_id", "supersedes_id")).alias("record_id")).where("record_id is not null").distinct()
        known = stored.select("record_id", "record_hash", "entity_id").join(named, "record_id", "left_semi")
        by_id = known.select(F.col("record_id").alias("_key"), F.col("record_hash").alias("_hash"))
        targets = known.select(F.col("record_id").alias("_target"), F.col("entity_id").alias("_inherited"))
        df = df.withColumn("_target", F.coalesce("supersedes_id", own)).join(targets, "_target", "left").join(by_id, "_key", "left").drop("_target")
    same = Window.partitionBy("_key").orderBy("index")
    place = F.row_number().over(same)
    first_hash = F.first("record_hash").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return outcomes(df, place, first_hash).drop("_key")


def outcomes(df: DataFrame, place: Column, first_hash: Column) -> DataFrame:
    """The outcome of rows with the hash and the entity that are stored of them, their place among equal ids and the hash of the
    first of these."""
    fine = F.col("error_id").isNull()
    entity = F.coalesce("explicit_entity_id", "_inherited", "record_id")
    df = df.withColumn("entity_id", entity).withColumn("repeat", F.when(fine, place)).withColumn("_first_hash", first_hash)
    known = F.coalesce("_hash", F.when(F.col("repeat") > 1, F.col("_first_hash")))
    return df.withColumn("error_id", F.when(~fine, F.col("error_id")).when(known.isNotNull() & (known != F.col("record_hash")), "bad_record.reusing_id")).withColumn(
        "already_present", fine & known.isNotNull() & (known == F.col("record_hash"))
    ).withColumn("inserted", fine & known.isNull())


def check_call(outcome: DataFrame, store: Store, namespace: str, stored: DataFrame, semantics: str, apart: bool = False) -> dict:
    """Raises the conditions that refuse the whole call, with `apart` also that a record supersedes another of the call; returns
    the call's figures: odd, inserted, moved, superseding, versions.

    One aggregate over the call finds what needs looking at; joins with the store are made only for that.
    """
    fine = outcome.where(F.col("inserted") | F.col("already_present") | (F.col("error_id") == "bad_record.reusing_id"))
    example = lambda condition, column: F.min(F.when(condition, F.col(column)))
    linked, bare = F.col("supersedes_id").isNotNull(), F.col("explicit_entity_id").isNull()
    found = fine.agg(
        F.count_if("odd").alias("odd"),
        F.count_if("inserted").alias("inserted"),
        F.count_if(F.col("odd") & F.col("inserted")).alias("moved"),
        F.count("supersedes_id").alias("linked"),
        F.count_if(F.col("inserted") & linked).alias("superseding"),
        F.count_if(F.col("inserted") & (F.col("entity_id") != F.col("record_id"))).alias("versions"),
        example(linked & ~bare & (F.col("explicit_entity_id") != F.col("_inherited")), "supersedes_id").alias("mismatch"),
        example(linked & bare & F.col("_inherited").isNull(), "supersedes_id").alias("missing"),
        example((F.col("repeat") > 1) & F.col("_hash").isNull(), "record_id").alias("repeated"),
    ).first()
    superseding = fine.where(linked)
    if found.linked:
        if apart:
            within = superseding.select(F.col("supersedes_id").alias("record_id")).join(fine.where("inserted").select("record_id"), "record_id", "left_semi")
            if row := some(within.limit(1)):
                raise EngineError("internal_error.superseded_within_group", "a record supersedes one of the same group", **row)
        twice = some(superseding.groupBy("supersedes_id").count().where("count > 1").limit(1))
        if twice:
            raise EngineError("bad_request.duplicate_supersedes", "two records of the call supersede the same one", supersedes_id=twice["supersedes_id"])
        taken = store.read("superseded", namespace).select(F.col("record_id").alias("supersedes_id"), F.col("by_record_id").alias("_by"))
        conflict = superseding.join(taken, "supersedes_id")
        if semantics == "intended":  # the same record again is a harmless duplicate
            conflict = conflict.where(F.col("_by") != F.col("record_id"))
        if store.holds("superseded") and (row := some(conflict.select("supersedes_id").limit(1))):
            raise EngineError("bad_request.already_superseded", "the record is superseded already", **row)
        if found.mismatch:
            raise EngineError("bad_record.superseded_entity_id_mismatch", "the superseded record has another entity id", supersedes_id=found.mismatch)
        if found.missing:
            raise EngineError("internal_error.superseded_record_not_found", "the superseded record is not stored", supersedes_id=found.missing)
    if semantics == "reference":
        if found.repeated:
            raise EngineError("internal_error.duplicate_id", "an id occurs twice in the call", record_id=found.repeated)
        if found.inserted and len(store.config.namespaces) > 1:
            elsewhere = store.read("records").where(F.col("namespace") != namespace).select("record_id")
            # a look at the folders of other namespaces spares most calls the join
            if elsewhere.limit(1).count() and (row := some(fine.where("inserted").join(elsewhere, "record_id", "left_semi").select("record_id").limit(1))):
                raise EngineError("internal_error.duplicate_id", "the id is used in another namespace", **row)
    elif found.inserted:
        active = stored.where("not is_superseded and not is_deletion_marker").select("entity_id", F.col("record_id").alias("_active"))
        second = fine.where("inserted and supersedes_id is null").join(active, "entity_id")
        if row := some(second.select("entity_id").limit(1)):
            raise EngineError("bad_record.entity_has_active_record", "the entity has an active record", **row)
    return found.asDict()


def ingest_lines(store: Store, namespace: str, lines: DataFrame, batch_name: str | None = None, batch_time: datetime | None = None, also: dict[str, DataFrame] | None = None, at_once: bool = False, apart: bool = False) -> IngestResult:
    """One commit of lines(index, line); also: rows for other tables, written in the same commit; at_once: what a record of the
    call supersedes is superseded even if it is of the call as well."""
    store.config.check_namespace(namespace)
    spark, semantics, commit = store.spark, store.config.semantics, store.next_commit()
    staged = store.staging(commit, uuid.uuid4().hex)
    # parsed once, as the checks and the appends all read it; in small row groups, so that its tasks can be
    lines = parse_lines(lines, namespace, store.config.limits, semantics).drop("paths")
    lines.write.options(**STAGED).option("parquet.block.size", TASK_BYTES).parquet(f"{staged}-parsed")
    parsed = spark.read.schema(lines.schema).parquet(f"{staged}-parsed")
    stored = store.collection(namespace).records
    checked = classify_call(parsed.select(*CLASSIFIED), store.read("records", namespace) if store.holds("records") else None, semantics, f"{staged}-met")
    # most records are stored as they are, under the entity that they state: the others are odd
    own_entity = F.coalesce("explicit_entity_id", "record_id")
    checked = checked.drop("record_hash").withColumn("odd", ~F.col("inserted") | (F.col("entity_id") != own_entity))
    checked.write.options(**STAGED).parquet(f"{staged}-outcome")
    outcome = spark.read.schema(checked.schema).parquet(f"{staged}-outcome")
    try:
        found = check_call(outcome, store, namespace, stored, semantics, apart)
    except EngineError:
        for name in ("parsed", "outcome", "met"):
            store.filesystem().delete(spark._jvm.org.apache.hadoop.fs.Path(f"{staged}-{name}"), True)
        raise
    n = found["inserted"]
    # only the odd ones are joined, so that documents and entries stay where they were parsed unless these are many
    rows = parsed.where("error_id is null")
    if found["odd"]:
        odd = outcome.where("odd and (inserted or already_present or error_id = 'bad_record.reusing_id')").select("index", "inserted", F.col("entity_id").alias("_entity"))
        if found["odd"] <= FEW_ODD:
            rows = rows.join(F.broadcast(odd), "index", "left").where("coalesce(inserted, true)")
            rows = rows.withColumn("entity_id", F.coalesce("_entity", own_entity))
        else:
            rows = among(rows, odd.where("not inserted")).where("not _among").drop("_among")
            stay = rows.withColumn("entity_id", own_entity)
            if found["moved"]:
                moved = odd.where("inserted").select("index", F.col("_entity").alias("entity_id"))
                rows = among(rows, moved)
                stay = rows.where("not _among").withColumn("entity_id", own_entity).unionByName(rows.where("_among").join(moved.hint("merge"), "index"))
            rows = stay.drop("_among")
    else:
        rows = rows.withColumn("entity_id", own_entity)
    if n:
        with task_bytes(spark, TASK_BYTES):
            store.append(commit, "records", rows, n)
            index = field_index(rows)
            store.append(commit, "field_index", index, n)
        store.append(commit, "key_counts", index.groupBy("namespace", "key_name").agg(F.count(F.lit(1)).alias("n")))
    if found["superseding"]:
        marks = outcome.where("inserted and supersedes_id is not null")
        store.append(commit, "superseded", marks.select(F.col("supersedes_id").alias("record_id"), F.col("record_id").alias("by_record_id"), F.lit(at_once).alias("at_once"), "namespace"))
    if found["versions"]:
        store.append(commit, "entities", outcome.where("inserted and entity_id != record_id"), n)
    # the dictionary also learns the keys of records that are refused or known
    source = parsed.where("error_id is null") if semantics == "reference" else rows
    keys = source.select("namespace", F.explode("entries.key_name").alias("key_name")).distinct()
    store.append(commit, "field_keys", keys.join(store.read("field_keys", namespace).select("key_name"), "key_name", "left_anti"))
    if batch_name is not None:
        when = batch_time or datetime.now(UTC)
        store.append(commit, "processed_batches", spark.createDataFrame([(batch_name, when, namespace)], "batch_name string, batch_timestamp timestamp, namespace string"))
    for table, extra in (also or {}).items():
        store.append(commit, table, extra)
    store.mark(commit)
    # the status is read later, the rest is not
    for name in ("parsed", "met"):
        store.filesystem().delete(spark._jvm.org.apache.hadoop.fs.Path(f"{staged}-{name}"), True)
    status = outcome.select("index", "record_id", F.col("error_id").isNull().alias("ok"), "already_present", "inserted", "error_id")
    return IngestResult(commit, status)


def insert_one(store: Store, namespace: str, document: dict) -> dict:
    """One record; its superseded record must exist, and an item's error is raised."""
    target = document.get("supersedes_id")
    if isinstance(target, str) and not store.collection(namespace).records.where(F.col("record_id") == target.lower()).limit(1).count():
        raise EngineError("bad_request.cannot_supersede_nonexistent", "the superseded record does not exist", supersedes_id=target)
    result = ingest_lines(store, namespace, lines_frame(store.spark, [canonical_json(document)]))
    row = result.status.first()
    if not row.ok:
        raise EngineError(row.error_id)
    return {"namespace": namespace, "uuid": row.record_id}


def upsert(store: Store, namespace: str, document: dict) -> dict:
    """Inserts a version of an entity that supersedes its active record, unless nothing but id and time would change."""
    spark, semantics = store.spark, store.config.semantics
    parsed = parse_lines(lines_frame(spark, [canonical_json(document)]), namespace, store.config.limits, semantics).drop("entries", "paths").first()
    if parsed.error_id:
        raise EngineError(parsed.error_id)
    if parsed.explicit_entity_id is None:
        raise EngineError("bad_request.upsert.missing_entity_id", "an upsert needs an entity id")
    records = store.collection(namespace).records
    active = records.where((F.col("entity_id") == parsed.explicit_entity_id) & ~F.col("is_superseded") & ~F.col("is_deletion_marker"))
    old = active.orderBy(F.desc("record_timestamp"), F.desc("record_id")).first()
    if old is not None:
        if parsed.record_timestamp < old.record_timestamp:
            raise EngineError("bad_request.upsert_timestamp_back", "the entity has a later record", stored=str(old.record_timestamp))
        if parsed.content_hash == old.content_hash:
            return {"entity_id": old.entity_id, "record_id": old.record_id, "superseded_record_id": None, "created": False, "updated": False}
        if parsed.supersedes_id is not None and parsed.supersedes_id != old.record_id:
            raise EngineError("bad_request.supersede_mismatch", "another record is active", active=old.record_id)
        document = {**document, "supersedes_id": old.record_id}
    result = ingest_lines(store, namespace, lines_frame(spark, [canonical_json(document)])).status.first()
    if not result.ok and semantics == "intended":
        raise EngineError(result.error_id)
    none = ZERO_UUID if semantics == "reference" else None
    return {"entity_id": parsed.explicit_entity_id, "record_id": parsed.record_id, "superseded_record_id": old.record_id if old else none, "created": old is None, "updated": True}


@dataclass
class UpsertResult:
    """status: (index, entity_id, record_id, outcome, error_id) per item; outcome: created, updated, unchanged or refused."""

    status: DataFrame
    inserted: IngestResult


def upsert_lines(store: Store, namespace: str, lines: DataFrame) -> UpsertResult:
    """Upserts lines(index, line) in one commit, as if each had been sent by itself, an entity's in the order of their times.

    An item is refused if it is no record, has no entity id, is older than its entity's active record, or states another record to
    supersede than that one. Each entity's items form a chain: an item that changes nothing but id and time is left out; any
    other supersedes the one before it. What a version supersedes is part of its content, so only an entity's first version can be
    equal to a document that does not say so.
    """
    spark, semantics = store.spark, store.config.semantics
    staged = store.staging(store.next_commit(), uuid.uuid4().hex)
    parse_lines(lines, namespace, store.config.limits, semantics).drop("paths", "entries").write.options(**STAGED).parquet(f"{staged}-upserts")
    parsed = spark.read.parquet(f"{staged}-upserts").withColumnRenamed("explicit_entity_id", "entity_id")
    called = parsed.where("entity_id is not null").select("entity_id").distinct()
    shown = store.collection(namespace).records.where("not is_superseded and not is_deletion_marker")
    latest = lambda c: F.max_by(c, F.struct("record_timestamp", "record_id")).alias(f"_active_{c}")
    active = shown.select("entity_id", "record_id", "record_timestamp", "content_hash").join(called, "entity_id", "left_semi")
    active = active.groupBy("entity_id").agg(*(latest(c) for c in ("record_id", "record_timestamp", "content_hash")))
    # items without an entity have keys of their own and do not meet in one task
    own = F.concat(F.lit("line "), F.col("index").cast("string"))
    df = parsed.withColumn("_key", F.coalesce("entity_id", own)).join(active.withColumnRenamed("entity_id", "_key"), "_key", "left")
    error = F.when(F.col("error_id").isNotNull(), F.col("error_id")).when(F.col("entity_id").isNull(), "bad_request.upsert.missing_entity_id")
    error = error.when(F.col("record_timestamp") < F.col("_active_record_timestamp"), "bad_request.upsert_timestamp_back")
    error = error.when(F.col("supersedes_id").isNotNull() & ~F.col("supersedes_id").eqNullSafe(F.col("_active_record_id")), "bad_request.supersede_mismatch")
    df = df.withColumn("error_id", error)
    chain = Window.partitionBy("_key", F.col("error_id").isNull()).orderBy("record_timestamp", "index")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_differs", F.col("content_hash") != F.coalesce("_active_content_hash", F.first("content_hash").over(chain)))
    fresh = F.col("_active_content_hash").isNull() & (F.row_number().over(chain) == 1)
    same = ~F.col("_differs") & ~F.coalesce(F.max("_differs").over(earlier), F.lit(False))
    df = df.withColumn("outcome", F.when(F.col("error_id").isNotNull(), "refused").when(fresh, "created").when(same, "unchanged").otherwise("updated"))
    kept = F.when(F.col("outcome").isin("created", "updated"), F.col("record_id"))
    last = F.last(kept, ignorenulls=True).over(earlier)
    df = df.withColumn("_after", F.coalesce(last, F.col("_active_record_id")))
    df.select("index", "entity_id", "record_id", "outcome", "error_id", "_after", F.when(kept.isNotNull(), F.col("record_data")).alias("record_data")).write.options(**STAGED).parquet(f"{staged}-chain")
    done = spark.read.parquet(f"{staged}-chain")
    link = F.concat(F.lit('{"supersedes_id":"'), "_after", F.lit('",'), F.expr("substring(record_data, 2)"))
    fresh = done.where("record_data is not null").select("index", F.coalesce(link, F.col("record_data")).alias("line"))
    result = ingest_lines(store, namespace, fresh, at_once=True)
    refused = result.status.where("error_id is not null").select("index", F.col("error_id").alias("_refused"))
    status = done.join(refused, "index", "left")
    status = status.select("index", "entity_id", "record_id", F.when(F.col("_refused").isNotNull(), "refused").otherwise(F.col("outcome")).alias("outcome"), F.coalesce("_refused", "error_id").alias("error_id"))
    return UpsertResult(status, result)


def upsert_outcomes(versions: DataFrame) -> DataFrame:
    """For versions(entity_id, record_id, record_timestamp, content_hash) in time order: what an upsert of each would do."""
    w = Window.partitionBy("entity_id").orderBy("record_timestamp", "record_id")
    before = F.lag("content_hash").over(w)
    return versions.select("entity_id", "record_id", F.when(before.isNull(), "created").when(before == F.col("content_hash"), "unchanged").otherwise("updated").alias("outcome"))


def now_text() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def fill_in(document: dict) -> dict:
    """A document to put, with an id and a time if it has none."""
    out = dict(document)
    if not any(k in out for k in RECORD_ID_KEYS):
        out["record_id"] = str(uuid.uuid4())
    if not any(k in out for k in TIMESTAMP_KEYS):
        out["timestamp"] = now_text()
    return out


def hide(store: Store, namespace: str, record_id: str) -> dict:
    """A deletion marker that supersedes the record."""
    return insert_one(store, namespace, {"record_id": str(uuid.uuid4()), "supersedes_id": record_id, "timestamp": now_text(), "_deletion_marker": True})


def override(store: Store, namespace: str, record_id: str, document: dict) -> dict:
    """A new version of the record: the document, out of its envelope and without old ids and times."""
    body = document.get("record", document) if isinstance(document.get("record"), dict) else document
    body = {k: v for k, v in body.items() if k not in (*RECORD_ID_KEYS, *TIMESTAMP_KEYS)}
    return insert_one(store, namespace, fill_in({**body, "supersedes_id": record_id}))


def friendly_query(document: dict) -> dict:
    """A query document as it is, or a plain document as the filter of one."""
    return document if "filter" in document else {"filter": document}


def is_entity_alias(name: str) -> bool:
    return name.lower().replace("-", "").replace("_", "") in ("ent", "entity", "entityid")


def document_text(text: str, semantics: str = "reference") -> dict:
    """The object that a request body holds; in reference semantics what follows it is ignored."""
    try:
        value = first_json(text) if semantics == "reference" else parse_json(text)
    except ValueError as e:
        raise EngineError("bad_record.invalid_json", str(e)) from None
    if not isinstance(value, dict):
        raise EngineError("bad_record.not_an_object")
    return value


