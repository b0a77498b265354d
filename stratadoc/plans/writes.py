"""Named queries that run the write side over whole tables - calls, upserts, versions, batches, directory syncs, the calls of
the API and the command line - and return what a reader finds afterwards, with their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.config import Limits
from stratadoc.operators import ingest
from stratadoc.operators.metadata import parse_lines
from stratadoc.plans import planner
from stratadoc.plans.builders import CONFIG, base_folder, collection, iso, lines_of, named, new_store, parsed, read, store_of
from stratadoc.plans.catalogue import E, ITEMS, OPTIONAL_VALUES, add, optional_forms, uid
from stratadoc.plans.spec import compile_query
from stratadoc.sources.store import Store

_made: dict[tuple[str, str, str], object] = {}


def once(make: Callable[[SparkSession, str], object]) -> Callable[[SparkSession, str], object]:
    """What `make` wrote, written at its first use in a session."""

    def get(spark: SparkSession, sf_dir: str) -> object:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        if key not in _made:
            _made[key] = make(spark, sf_dir)
        return _made[key]

    return get


def everything(**more: object):
    return compile_query({"limit": 0, **more})


# --- two calls: a part of the events is there already, some with another body, and some lines of the second are cut -------


@once
def two_calls(spark: SparkSession, sf_dir: str) -> tuple[Store, ingest.IngestResult]:
    store = new_store(spark, "calls")
    every = lines_of(spark, sf_dir, "events")
    other = F.concat(F.lit('{"other":1,'), F.expr("substring(line, 2)"))
    first = every.where("index % 7 = 0").withColumn("line", F.when(F.col("index") % 50 == 0, other).otherwise(F.col("line")))
    ingest.ingest_lines(store, "events", first, batch_name="first")
    cut = every.withColumn("line", F.when(F.col("index") % 60 == 59, F.substring("line", 1, 20)).otherwise(F.col("line")))
    return store, ingest.ingest_lines(store, "events", cut, batch_name="second")


@add("write_status", f"select *, error_id is null ok from ({ITEMS})")
def write_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_calls(spark, sf_dir)[1].status


@add("write_summary", f"select count(*) num_records, count(*) filter (error_id is null) num_ok, count(*) filter (already_present) num_already_present, count(*) filter (inserted) num_inserted, count(*) filter (error_id is not null) num_error, bool_and(error_id is null) all_ok from ({ITEMS})")
def write_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summary(two_calls(spark, sf_dir)[1].status)


STORED = "(event_id % 60 <> 59 or event_id % 7 = 0)"


@add("write_records", f"select {E} record_id, {E} entity_id, epoch_us(ts) micros, case when event_id % 350 = 0 then 1 end other, event_type, false is_deletion_marker from events where {STORED}")
def write_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = two_calls(spark, sf_dir)[0].collection("events").records
    body = lambda k: F.get_json_object("record_data", f"$.{k}")
    return r.select("record_id", "entity_id", F.unix_micros("record_timestamp").alias("micros"), body("other").cast("int").alias("other"), body("event_type").alias("event_type"), "is_deletion_marker")


@add("write_fields", f"select field, sum(n) as count from (select unnest(['event_type', 'props', 'props.k', 'record_id', 'seq', 'tags', 'tags[]', 'tags[]', 'timestamp', 'user_id', 'value']) field, 1 n from events where {STORED} union all select 'other', 1 from events where event_id % 350 = 0) group by field")
def write_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.fields_query(two_calls(spark, sf_dir)[0].collection("events"), compile_query({}))


@add("write_key_dictionary", "select distinct '.' || unnest(['event_type', 'props', 'record_id', 'seq', 'tags', 'tags[]', 'timestamp', 'user_id', 'value']) key_name from events union select '.props.' || unnest(json_keys(props)) from events union select '.other' from events where event_id % 350 = 0")
def write_key_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_calls(spark, sf_dir)[0].read("field_keys", "events").select("key_name")


@add("write_ledger", "select * from (values (0, 'second', true), (1, 'none', false), (2, 'first', true)) t(place, batch_name, processed) where exists (select 1 from events)")
def write_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = two_calls(spark, sf_dir)[0].read("processed_batches").where("batch_timestamp is not null")
    return planner.check_batches(ledger, "events", ["second", "none", "first"], spark)


@add("write_sizes", "select unnest(['field_index', 'field_keys', 'key_counts', 'processed_batches', 'records']) as name where exists (select 1 from events)")
def write_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that hold something."""
    sizes = two_calls(spark, sf_dir)[0].sizes()
    return spark.createDataFrame([(k,) for k, n in sizes.items() if n], "name string")


@add("write_compacted", f"select {E} record_id, event_type from events")
def write_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read after all commits were rewritten into one folder and the old ones deleted."""
    store = new_store(spark, "compacted")
    every = lines_of(spark, sf_dir, "events")
    for part in ("index % 7 = 0", "index % 7 <> 0"):
        ingest.ingest_lines(store, "events", every.where(part))
    store.compact()
    store.clean()
    r = planner.records_query(store.collection("events"), everything(filter={"event_type": None}))
    return r.select("record_id", F.get_json_object("record_data", "$.event_type").alias("event_type"))


# --- versions: overriding, hiding, inherited entities -----------------------------------------------------


@once
def versions(spark: SparkSession, sf_dir: str) -> Store:
    """All events; then a new version of every fourth; then a deletion marker for every tenth."""
    store = new_store(spark, "versions")
    e = read(spark, sf_dir, "events")
    time, own = iso("ts").alias("timestamp"), named("event", "event_id")
    calls = (
        (e, F.struct(own.alias("record_id"), time, "event_type")),
        (e.where("event_id % 4 = 0"), F.struct(named("over", "event_id").alias("record_id"), time, F.lit("over").alias("event_type"), own.alias("supersedes_id"))),
        (e.where("event_id % 10 = 9"), F.struct(named("hide", "event_id").alias("record_id"), time, own.alias("supersedes_id"), F.lit(True).alias("_deletion_marker"))),
    )
    for rows, document in calls:
        ingest.ingest_lines(store, "versions", rows.select(F.col("event_id").alias("index"), F.to_json(document).alias("line")))
    return store


OVER, HIDE = uid("over", "event_id"), uid("hide", "event_id")


@add("write_versions", f"select {E} record_id, {E} entity_id, event_id % 4 = 0 or event_id % 10 = 9 is_superseded, false is_deletion_marker from events union all select {OVER}, {E}, false, false from events where event_id % 4 = 0 union all select {HIDE}, {E}, false, true from events where event_id % 10 = 9")
def write_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).collection("versions").records.select("record_id", "entity_id", "is_superseded", "is_deletion_marker")


@add("write_visible", f"select case when event_id % 4 = 0 then {OVER} else {E} end record_id from events where event_id % 10 <> 9")
def write_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.records_query(versions(spark, sf_dir).collection("versions"), everything(), columns=("record_id",))


@add("write_visible_fields", "select unnest(['event_type', 'record_id', 'timestamp']) field, count(*) as count from events where event_id % 10 <> 9 group by 1 union all select 'supersedes_id', count(*) from events where event_id % 4 = 0 having count(*) > 0")
def write_visible_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.fields_query(versions(spark, sf_dir).collection("versions"), compile_query({}))


@add("write_entity_lookup", f"select {OVER} record_id, {E} entity_id from events where event_id = 8")
def write_entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    entity = str(uuid.UUID(hashlib.md5(b"event:8").hexdigest()))
    return planner.lookup_entity(versions(spark, sf_dir).collection("versions"), entity).select("record_id", "entity_id")


# --- upserts ---------------------------------------------------------------------------------------


@once
def upserts(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """Every event as an upsert of its user; then one more of each user, with another type for the odd ones."""
    store = new_store(spark, "upserts")
    e = read(spark, sf_dir, "events")
    document = F.struct(named("event", "event_id").alias("record_id"), iso("ts").alias("timestamp"), named("user", "user_id").alias("entity_id"), "event_type")
    first = ingest.upsert_lines(store, "versions", e.select(F.col("event_id").alias("index"), F.to_json(document).alias("line")))
    users = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    kind = F.when(F.col("user_id") % 2 == 1, "again").otherwise(F.col("event_type")).alias("event_type")
    document = F.struct(named("again", "user_id").alias("record_id"), F.lit("2090-01-01T00:00:00Z").alias("timestamp"), named("user", "user_id").alias("entity_id"), kind)
    second = ingest.upsert_lines(store, "versions", users.select(F.col("user_id").alias("index"), F.to_json(document).alias("line")))
    return store, first.status.unionByName(second.status)


AGAIN, USER = uid("again", "user_id"), uid("user", "user_id")
CHAIN = "select *, row_number() over (partition by user_id order by ts, event_id) place, coalesce(bool_or(event_type <> first_type) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) changed from (select *, first_value(event_type) over (partition by user_id order by ts, event_id) first_type from events)"
UPSERTED = f"select *, case when place = 1 then 'created' when event_type = first_type and not changed then 'unchanged' else 'updated' end outcome from ({CHAIN})"
USERS = "select user_id, bool_or(event_type <> first_type) changed from (select *, first_value(event_type) over (partition by user_id order by ts, event_id) first_type from events) group by user_id"


@add("write_upserts", f"select {E} record_id, {USER} entity_id, outcome from ({UPSERTED}) union all select {AGAIN}, {USER}, case when changed or user_id % 2 = 1 then 'updated' else 'unchanged' end from ({USERS})")
def write_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts(spark, sf_dir)[1].where("error_id is null").select("record_id", "entity_id", "outcome")


@add("write_upsert_active", f"select case when changed or user_id % 2 = 1 then {AGAIN} else first_id end record_id, {USER} entity_id from ({USERS}) join (select user_id, {E} first_id from ({CHAIN}) where place = 1) using (user_id)")
def write_upsert_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts(spark, sf_dir)[0].collection("versions").records.where("not is_superseded").select("record_id", "entity_id")


# --- directory sync ---------------------------------------------------------------------------------

#: Lines of one length, so that SQL knows where the splitter cuts.
SYNC_EVENTS, SYNC_LINES, SEQ_DIGITS = 100_000, 500, 12
SYNC_LINE = f"'{{\"id\":\"' || {E} || '\",\"seq\":\"' || lpad(cast(event_id as varchar), {SEQ_DIGITS}, '0') || '\",\"time\":1700000000}}'"
SYNCED = f"select event_type, event_id // {SYNC_EVENTS} part, event_id, {SYNC_LINE} line, (row_number() over (partition by event_type, event_id // {SYNC_EVENTS} order by event_id) - 1) // {SYNC_LINES} as batch from events"


@once
def synced(spark: SparkSession, sf_dir: str) -> Store:
    """All events as JSONL files by type and id range, synced from their folder; a second pass finds nothing new."""
    from stratadoc.streaming.sync import sync_directory

    width = len('{"id":"","seq":"","time":1700000000}') + 36 + SEQ_DIGITS
    limits = Limits(sync_batch_bytes=SYNC_LINES * (width + 1) - 1)
    store = new_store(spark, "sync", replace(CONFIG, limits=limits))
    folder = f"{base_folder(spark)}/sync-{uuid.uuid4().hex}"
    line = F.concat(F.lit('{"id":"'), named("event", "event_id"), F.lit('","seq":"'), F.lpad(F.col("event_id").cast("string"), SEQ_DIGITS, "0"), F.lit('","time":1700000000}'))
    e = read(spark, sf_dir, "events").select("event_type", F.expr(f"event_id div {SYNC_EVENTS}").alias("part"), "event_id", line.alias("value"))
    staged = f"{folder}-text"
    e.repartition("event_type", "part").sortWithinPartitions("event_type", "part", "event_id").drop("event_id").write.partitionBy("event_type", "part").text(staged)
    # the sync takes files by their names
    system = store.filesystem()
    path = spark._jvm.org.apache.hadoop.fs.Path
    for row in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(staged).select("path").toLocalIterator():
        kind, part = row.path.split("/event_type=")[1].split("/")[0], row.path.split("/part=")[1].split("/")[0]
        system.mkdirs(path(f"{folder}/{kind}"))
        system.rename(path(row.path), path(f"{folder}/{kind}/{part}.jsonl"))
    done = sync_directory(store, "events", folder)
    if done.errors or sync_directory(store, "events", folder) is not None:
        raise AssertionError("the second pass should find nothing new")
    return store


@add("sync_batches", f"select digest from (select sha256(string_agg(line, chr(10) order by event_id)) digest from ({SYNCED}) group by event_type, part, batch)")
def sync_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synced(spark, sf_dir).read("synced_batches", "events").select("digest")


@add("sync_files", f"select event_type || '/' || (event_id // {SYNC_EVENTS}) || '.jsonl' as name, sum(octet_length(encode({SYNC_LINE})) + 1) as size from events group by 1")
def sync_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synced(spark, sf_dir).read("synced_files", "events")
    return rows.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("name"), "size")


@add("sync_records", f"select {E} record_id, lpad(cast(event_id as varchar), {SEQ_DIGITS}, '0') seq from events")
def sync_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = planner.records_query(synced(spark, sf_dir).collection("events"), everything())
    return r.select("record_id", F.get_json_object("record_data", "$.seq").alias("seq"))


# --- parsing ------------------------------------------------------------------------------------------

ID, TIME = '"id":"@"', '"time":1700000000'
#: Line, with the event's id for @, and the error that it gives.
DEFECTS = (
    (f"{{{ID},{TIME}}}", None),
    (f"{{{ID},{TIME}", "bad_record.invalid_json"),
    ("[1]", "bad_record.not_an_object"),
    (f"{{{TIME}}}", "bad_record.missing_id"),
    (f'{{"id":5,{TIME}}}', "bad_record.record_id.invalid.not_a_string"),
    (f'{{"id":"x",{TIME}}}', "bad_record.record_id.invalid.bad_uuid"),
    (f'{{"id":"00000000-0000-0000-0000-000000000000",{TIME}}}', "bad_record.record_id.zero_uuid"),
    (f'{{{ID},"entity_id":"x",{TIME}}}', "bad_record.entity_id.invalid.bad_uuid"),
    (f"{{{ID}}}", "bad_record.missing_timestamp"),
    (f'{{{ID},"time":"yesterday"}}', "invalid_timestamp"),
    (f'{{{ID},{TIME},"supersedes":"x"}}', "bad_record.false_friend"),
    (f'{{{ID},{TIME},"supersedes_id":"x"}}', "bad_record.invalid_supersedes_id"),
    (f'{{{ID},{TIME},"locked_until":"x"}}', "bad_record.invalid_locked_until"),
)


@add("parse_errors", f"select event_id as index, case event_id % {len(DEFECTS)} {' '.join(f'when {k} then ' + (f'{chr(39)}{e}{chr(39)}' if e else 'null') for k, (_, e) in enumerate(DEFECTS))} end error_id, case when event_id % {len(DEFECTS)} = 0 then {E} end record_id from events")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*(F.lit(t) for t, _ in DEFECTS))
    line = F.replace(F.get(forms, (F.col("event_id") % len(DEFECTS)).cast("int")), F.lit("@"), named("event", "event_id"))
    return parse_lines(read(spark, sf_dir, "events").select(F.col("event_id").alias("index"), line.alias("line")), "events").select("index", "error_id", "record_id")


def content_of(keys: list[str]) -> str:
    own = [k for k in keys if k not in ("record_id", "timestamp")]
    return "sha256('{' || " + " || ',' || ".join(f"'\"{k}\":' || {OPTIONAL_VALUES[k]}" for k in own) + " || '}')"


@add("content_hash", f"select {E} record_id, {optional_forms(content_of)} content_hash from events")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir, "optional").select("record_id", "content_hash")


def text_of(keys: list[str]) -> str:
    return "length('{' || " + " || ',' || ".join(f"'\"{k}\":' || {OPTIONAL_VALUES[k]}" for k in keys) + " || '}')"


@add("stats_chars", f"select count(*) records, sum(n) record_chars, max(n) longest_record, sum(n) / count(*) mean_record_chars from (select {optional_forms(text_of)} n from events)")
def stats_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.stats(collection(spark, sf_dir, "optional")).select("records", "record_chars", "longest_record", "mean_record_chars")


# --- more reads ---------------------------------------------------------------------------------------


@add("omit_locked", f"select {E} record_id from events where event_id % 3 <> 0")
def omit_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = compile_query({"omit_locked": True, "limit": 0}, semantics="intended")
    return planner.records_query(collection(spark, sf_dir, "locked", "intended"), q, "intended", "2024-06-01 00:00:00", columns=("record_id",))


@add("fields_limit", "select field, n as count from (select 'k' || lpad(cast(event_id % 1500 as varchar), 4, '0') field, count(*) n from events group by 1 union all select unnest(['id', 'time']), count(*) from events group by 1) order by n desc, field limit 1000")
def fields_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.fields_query(collection(spark, sf_dir, "wide"), compile_query({}))


VALUES = f"(select * from events where event_type = 'error' order by ts, {E} limit 1000)"


@add("values_order", f"select 'user_id' field, row_number() over (order by value) - 1 as place, value, n as count from (select cast(user_id as varchar) as value, count(*) n from {VALUES} group by user_id)")
def values_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planner.values_query(collection(spark, sf_dir, "events"), compile_query({"filter": {"event_type": "error"}}), ["user_id"])
    return out.select("field", F.posexplode("values").alias("place", "v")).select("field", F.col("place").cast("long").alias("place"), "v.value", "v.count")


@add("records_raw_list", f"select {E} record_id, event_type from events where user_id = 8 order by ts, record_id limit 1000")
def records_raw_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of records as stored, with their documents, up to the usual limit."""
    r = planner.records_query(collection(spark, sf_dir, "events"), compile_query({"filter": {"user_id": 8}}))
    return r.select("record_id", F.get_json_object("record_data", "$.event_type").alias("event_type"))


# --- the calls of the API and the command line --------------------------------------------------------

CLICKS = "(select * from events where event_type = 'click' order by ts limit 1000)"
ROUTES = f"""
select 'records' route, 200 as status, count(*) n from {CLICKS}
union all select 'fields', 200, count(*) from (select distinct unnest(['event_type', 'props', 'props.k', 'record_id', 'seq', 'tags', 'tags[]', 'timestamp', 'user_id', 'value']) from events where event_type = 'click')
union all select 'values', 200, count(distinct user_id) from (select * from events where event_type = 'click' order by ts, {E} limit 1000)
union all select 'by_field', 200, max(event_id) from events where event_id = 42
union all select 'by_id', 200, max(event_id) from events where event_id = 7
union all select 'entity', 200, max(event_id) from events where event_id = 7
union all select unnest(['by_field', 'by_id', 'entity', 'batch', 'nothing']), 404, 0 where exists (select 1 from events)
union all select unnest(['records', 'records', 'by_id', 'record', 'check']), 400, 0 where exists (select 1 from events)
union all select unnest(['record', 'upsert', 'jsonl', 'batch_jsonl', 'check', 'batch']), unnest([200, 201, 200, 200, 200, 200]), unnest([1, 1, 2, 1, 1, 1]) where exists (select 1 from events)
union all select 'upsert', 200, 0 where exists (select 1 from events)
union all select unnest(['records', 'record', 'records']), 401, 0 where exists (select 1 from events)
"""


@add("api_calls", ROUTES)
def api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route, status, figure) of calls by method and path: reads over all events, and writes to a store of their own."""
    import base64
    import hashlib

    from stratadoc.api import Engine
    from stratadoc.config import Access, Client

    rows: list[tuple[str, int, int]] = []
    secret, quick = "s" * 64, replace(CONFIG.limits, refusal_seconds=0.0)
    config = replace(CONFIG, clients=(Client("reader", secret, {"events": Access(query=True)}), Client("writer", secret, {"versions": Access(query=True, ingest=True)})), limits=quick, accept_host="store")
    login = lambda name, key=secret: {"Host": "store", "Authorization": "Basic " + base64.b64encode(f"{name}:{key}".encode()).decode()}
    reads = Engine(spark, store_of(spark, sf_dir, "events").root, config)
    writes = Engine(spark, new_store(spark, "api").root, config)
    uuid_of = lambda text: str(uuid.UUID(hashlib.md5(text.encode()).hexdigest()))
    gone, clicks = str(uuid.uuid4()), json.dumps({"filter": {"event_type": "click"}})

    def call(route: str, figure: Callable[[dict], int], engine: Engine, method: str, path: str, body: str = "", headers: dict | None = None) -> None:
        status, out = engine.call(method, path, body, headers or login("reader" if engine is reads else "writer"))
        rows.append((route, status, figure(out) if status in (200, 201) else 0))

    seq = lambda out: int(out["record"]["seq"])
    none = lambda out: 0
    if reads.store.collection("events").records.limit(1).count():
        call("records", lambda o: len(o["records"]), reads, "POST", "/api/query/events/records/", clicks + " trailing text")
        call("fields", lambda o: len(o["fields"]), reads, "POST", "/api/query/events/fields/", clicks)
        call("values", lambda o: len(o["fields"][0]["values"]), reads, "POST", "/api/query/events/values/user_id/", clicks)
        call("by_id", seq, reads, "GET", f"/api/query/events/records/{uuid_of('event:7')}/")
        call("entity", seq, reads, "GET", f"/api/query/events/entities/{uuid_of('event:7')}/")
        call("by_field", none, reads, "GET", "/api/query/events/records/by/event_type/nothing/")
        call("by_id", none, reads, "GET", f"/api/query/events/records/{gone}/")
        call("entity", none, reads, "GET", f"/api/query/events/entities/{gone}/")
        call("nothing", none, reads, "GET", "/api/query/events/nothing/")
        call("records", none, reads, "POST", "/api/query/events/records/", '{"filters":{}}')
        call("records", none, reads, "POST", "/api/query/events/records/", "{")
        call("by_id", none, reads, "GET", "/api/query/events/records/x/")
        # a number's text form is not a string value: looked up through the planner's own call
        found = planner.lookup_field(reads.store.collection("events"), "seq", "42").collect()
        rows.append(("by_field", 200, json.loads(found[0].record_data)["seq"]))
        call("records", none, reads, "POST", "/api/query/events/records/", clicks, login("reader", "wrong"))
        call("records", none, reads, "POST", "/api/query/events/records/", clicks, {**login("reader"), "Host": "elsewhere"})
        document = {"id": uuid_of("api:1"), "time": 1700000000, "entity_id": uuid_of("api:e"), "n": 1}
        call("record", none, reads, "POST", "/api/ingest/events/record/", json.dumps(document))
        call("record", lambda o: 1, writes, "POST", "/api/ingest/versions/record/", json.dumps({**document, "entity_id": uuid_of("api:f")}))
        call("record", none, writes, "POST", "/api/ingest/versions/record/", json.dumps({"id": gone, "time": 1700000000, "supersedes_id": gone}))
        call("upsert", lambda o: int(o["updated"]), writes, "POST", "/api/ingest/versions/upsert/", json.dumps({**document, "id": uuid_of("api:2")}))
        call("upsert", lambda o: int(o["updated"]), writes, "POST", "/api/ingest/versions/upsert/", json.dumps({**document, "id": uuid_of("api:3")}))
        lines = "\n".join(json.dumps({"id": uuid_of(f"api:{k}"), "time": 1700000000}) for k in (4, 5))
        call("jsonl", lambda o: o["stats"]["num_inserted"], writes, "POST", "/api/ingest/versions/jsonl/", lines)
        call("batch_jsonl", lambda o: o["stats"]["num_inserted"], writes, "POST", "/api/ingest/versions/batches/b1/jsonl/", json.dumps({"id": uuid_of("api:6"), "time": 1700000000}))
        call("check", lambda o: sum(b["status"] == "processed" for b in o["batches"]), writes, "POST", "/api/ingest/versions/batches/check/", '{"batch_names":["b1","b2"]}')
        call("check", none, writes, "POST", "/api/ingest/versions/batches/check/", '{"batch_names":[]}')
        call("batch", lambda o: 1, writes, "GET", "/api/ingest/versions/batches/b1/")
        call("batch", none, writes, "GET", "/api/ingest/versions/batches/b2/")
    return spark.createDataFrame(rows, "route string, status int, n long").select("route", "status", "n")


@add("command_lines", f"select 'list' command, {E} line from events where event_type = 'signup' and user_id % 2 = 0 union all select 'values', count(*) || chr(9) || 'user_id' from {VALUES} union all select 'values', '  ' || count(*) || chr(9) || user_id from {VALUES} group by user_id")
def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the command line prints: ids of a list, and the indented counts of values."""
    from stratadoc.api import Engine
    from stratadoc.cli import list_lines, parser, run

    engine, command = Engine(spark, store_of(spark, sf_dir, "events").root, CONFIG), lambda *words: parser().parse_args(["--root", "x", "--namespace", "events", *words])
    users = read(spark, sf_dir, "events").where("event_type = 'signup' and user_id % 2 = 0").select("user_id").distinct()
    asked = [json.dumps({"filter": {"event_type": "signup", "user_id": r.user_id}, "limit": 0}) for r in users.toLocalIterator()]
    # the values' lines are bounded by the limit of their rows; the list's are not, and stay where they are
    values = [("values", x) for x in run(engine, command("values", "user_id", "--query", json.dumps({"filter": {"event_type": "error"}})))]
    out = spark.createDataFrame(values, "command string, line string")
    return out.unionAll(list_lines(engine, command("list", *asked)).select(F.lit("list").alias("command"), "line")) if asked else out
