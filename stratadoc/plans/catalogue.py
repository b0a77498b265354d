"""Named queries over the driver's tables, with their SQL.

The SQL reads the flat tables, so it does not depend on how documents are flattened. Results carry record ids, which both sides
derive from the tables' keys in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratadoc.operators import ingest
from stratadoc.operators.metadata import parse_lines
from stratadoc.plans import planner
from stratadoc.plans.builders import collection, lines_of, named, parsed, read, staged
from stratadoc.plans.spec import compile_query

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return put


def uid(kind: str, column: str) -> str:
    return f"regexp_replace(md5('{kind}:' || {column}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5')"


E, O = uid("event", "event_id"), uid("order", "o_orderkey")


def rows(name: str, namespace: str, request: dict, sql: str, semantics: str = "reference") -> None:
    """A records query that returns record_id, unlimited unless the request limits it."""

    @add(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = collection(spark, sf_dir, namespace, semantics)
        return planner.records_query(c, compile_query({"limit": 0, **request}, semantics=semantics), semantics, "2024-06-01 00:00:00", columns=("record_id",))


rows("filter_eq_string", "events", {"filter": {"event_type": "click"}}, f"select {E} record_id from events where event_type = 'click'")
rows("filter_eq_int", "events", {"filter": {"user_id": 8}}, f"select {E} record_id from events where user_id = 8")
rows("filter_nested_eq", "events", {"filter": {"props": {"k": 69}}}, f"select {E} record_id from events where cast(json_extract(props, '$.k') as bigint) = 69")
rows("filter_conjunction", "events", {"filter": {"event_type": "purchase", "user_id": 9}}, f"select {E} record_id from events where event_type = 'purchase' and user_id = 9")
rows("filter_array_contains", "orders", {"filter": {"lines": [{"flag": "R"}]}}, f"select {O} record_id from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R'")
rows("filter_array_contains_intended", "orders", {"filter": {"lines": [{"flag": "R"}]}}, f"select {O} record_id from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')", "intended")
TWO = {"filter": {"lines": [{"flag": "R"}, {"flag": "A"}]}}
rows("filter_same_key_two_values", "orders", TWO, f"select {O} record_id from orders where false")
rows("filter_same_key_two_values_intended", "orders", TWO, f"select {O} record_id from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A')", "intended")
rows("filter_present", "optional", {"filter": {"even": None}, "treat_nulls_as_absent": False}, f"select {E} record_id from events where event_id % 2 = 0")
rows("filter_present_not_null", "optional", {"filter": {"even": None}}, f"select {E} record_id from events where event_id % 2 = 0 and event_id % 5 <> 0")
rows("filter_present_overlong", "optional", {"filter": {"big": None}}, f"select {E} record_id from events where event_id % 11 = 0")
rows("filter_present_array", "events", {"filter": {"tags": [None]}}, f"select {E} record_id from events, range(2)")
rows("filter_wildcard_custom", "optional", {"filter": {"even": "*"}, "wildcard": "*"}, f"select {E} record_id from events where event_id % 2 = 0 and event_id % 5 <> 0")
rows("filter_raw", "events", {"raw": {"filter": {"fields_present": [".props"], "field_values": {".event_type": ['"view"']}}}}, f"select {E} record_id from events where event_type = 'view'")
rows("filter_empty", "events", {"filter": {"tags": [], "props": {}}}, f"select {E} record_id from events")
rows("exclude_value", "events", {"exclude": {"event_type": "click"}}, f"select {E} record_id from events where event_type <> 'click'")
rows("exclude_value_array", "events", {"exclude": {"tags": ["u0"]}}, f"select {E} record_id from events, (select 0 a union all select 1) where a = 0 or user_id % 3 <> 0")
rows("exclude_value_array_intended", "events", {"exclude": {"tags": ["u0"]}}, f"select {E} record_id from events where user_id % 3 <> 0", "intended")
rows("exclude_present_nulls_absent", "optional", {"exclude": {"even": None}}, f"select {E} record_id from events where event_id % 10 = 0")
rows("exclude_present_nulls_absent_intended", "optional", {"exclude": {"even": None}}, f"select {E} record_id from events where event_id % 2 = 1 or event_id % 10 = 0", "intended")
rows("exclude_present", "optional", {"exclude": {"even": None}, "treat_nulls_as_absent": False}, f"select {E} record_id from events where false")
rows("exclude_present_unknown_key", "optional", {"exclude": {"never": None}, "treat_nulls_as_absent": False}, f"select {E} record_id from events")
rows("exclude_present_intended", "optional", {"exclude": {"even": None}, "treat_nulls_as_absent": False}, f"select {E} record_id from events where event_id % 2 = 1", "intended")
rows("filter_and_exclude_same_key", "events", {"filter": {"tags": ["click"]}, "exclude": {"tags": ["u1"]}}, f"select {E} record_id from events where event_type = 'click'")
rows("filter_and_exclude_same_key_intended", "events", {"filter": {"tags": ["click"]}, "exclude": {"tags": ["u1"]}}, f"select {E} record_id from events where event_type = 'click' and user_id % 3 <> 1", "intended")
HISTORY = "select *, row_number() over (partition by user_id order by ts desc, event_id desc) = 1 as latest, event_id % 10 = 9 as hidden from events"
SHOWN = {"omit_superseded": True, "omit_hidden": False}
rows("omit_superseded_on", "history", SHOWN, f"select {E} record_id from ({HISTORY}) where latest")
rows("omit_superseded_off", "history", {"omit_superseded": False, "omit_hidden": False}, f"select {E} record_id from events")
rows("omit_hidden_on", "history", {"omit_superseded": False}, f"select {E} record_id from ({HISTORY}) where not hidden")
rows("omit_hidden_off", "history", {"omit_superseded": True, "omit_hidden": False, "filter": {"event_type": "view"}}, f"select {E} record_id from ({HISTORY}) where latest and event_type = 'view'")
rows("active_entities", "history", {}, f"select {E} record_id from ({HISTORY}) where latest and not hidden")
rows("omit_locked_intended", "events", {"omit_locked": True, "filter": {"event_type": "error"}}, f"select {E} record_id from events where event_type = 'error'", "intended")
rows("time_range", "orders", {"timestamp_start": "1996-01-01T00:00:00Z", "timestamp_end": "1997-01-01T00:00:00Z"}, f"select {O} record_id from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'")
rows("order_time_asc", "events", {"filter": {"event_type": "signup"}, "limit": 50}, f"select {E} record_id from events where event_type = 'signup' order by ts, record_id limit 50")
rows("order_time_desc", "events", {"order_by": "-time", "limit": 50}, f"select {E} record_id from events order by ts desc, record_id desc limit 50")
rows("order_id", "events", {"order_by": "id", "limit": 50}, f"select {E} record_id from events order by record_id limit 50")
rows("limit_topk", "texts", {"filter": {"lang": "en"}, "limit": 10}, f"select {uid('doc', 'doc_id')} record_id from documents where lang = 'en' order by record_id limit 10")


@add("order_random_count", "select 100 as n")
def order_random_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = collection(spark, sf_dir, "events")
    return planner.records_query(c, compile_query({"order_by": "random", "limit": 100})).agg(F.count(F.lit(1)).cast("int").alias("n"))


@add("record_projection", f"select {E} record_id, {E} entity_id, ts record_timestamp, '{{\"event_type\":\"' || event_type || '\",\"record_id\":\"' || {E} || '\"}}' head from events where event_type = 'error'")
def record_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = collection(spark, sf_dir, "events")
    r = planner.records_query(c, compile_query({"filter": {"event_type": "error"}, "limit": 0}))
    head = F.to_json(F.from_json("record_data", "event_type string, record_id string"))
    return r.select("record_id", "entity_id", F.col("record_timestamp").cast("timestamp_ntz").alias("record_timestamp"), head.alias("head"))


@add("record_envelope", f"select 'events' namespace, {E} record_id, cast(epoch_us(ts) as varchar) || '000' timestamp_unix_nano, user_id from events where event_type = 'signup'")
def record_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = collection(spark, sf_dir, "events")
    r = planner.envelope(planner.records_query(c, compile_query({"filter": {"event_type": "signup"}, "limit": 0})), "events")
    return r.select("namespace", "record_id", "timestamp_unix_nano", F.variant_get("record", "$.user_id", "long").alias("user_id"))


EVENT_FIELDS = [("event_type", 1), ("props", 1), ("props.k", 1), ("record_id", 1), ("seq", 1), ("tags", 1), ("tags[]", 2), ("timestamp", 1), ("user_id", 1), ("value", 1)]
FIELD_VALUES = ", ".join(f"('{f}', {n})" for f, n in EVENT_FIELDS)


def fields(name: str, request: dict, condition: str) -> None:
    sql = f"select f.field, f.n * (select count(*) from events where {condition}) as count from (values {FIELD_VALUES}) f(field, n)"

    @add(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return planner.fields_query(collection(spark, sf_dir, "events"), compile_query(request))


fields("fields_all", {}, "true")
fields("fields_filtered", {"filter": {"event_type": "click"}}, "event_type = 'click'")


def values(name: str, namespace: str, names: list[str], request: dict, sql: str) -> None:
    @add(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return planner.value_rows(collection(spark, sf_dir, namespace), compile_query(request), names).select(planner.display("key_name").alias("field"), "value", "count")


FIRST = f"(select * from events where event_type = 'error' order by ts, {E} limit 1000)"
values("values_single", "events", ["user_id"], {"filter": {"event_type": "error"}}, f"select 'user_id' field, cast(user_id as varchar) as value, count(*) as count from {FIRST} group by user_id")
values("values_multi", "events", ["user_id", "event_type"], {"filter": {"event_type": "error"}}, f"select 'user_id' field, cast(user_id as varchar) as value, count(*) as count from {FIRST} group by user_id union all select 'event_type', '\"error\"', count(*) from {FIRST}")
values("values_array", "events", ["tags[]"], {"filter": {"event_type": "error"}}, f"select 'tags[]' field, '\"' || tag || '\"' as value, count(*) as count from (select unnest([event_type, 'u' || (user_id % 3)]) tag from {FIRST}) group by tag")
values("values_nested", "events", ["props.k"], {"filter": {"event_type": "error"}}, f"select 'props.k' field, cast(json_extract(props, '$.k') as varchar) as value, count(*) as count from {FIRST} group by 2")


@add("values_zero_fill", f"select 'event_type' field, count(*) as count, 1 as n_values from {FIRST} union all select 'gone', 0, 0")
def values_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planner.values_query(collection(spark, sf_dir, "events"), compile_query({"filter": {"event_type": "error"}}), ["gone", "event_type"])
    return out.select("field", "count", F.size("values").alias("n_values"))


@add("lookup_record", f"select {E} record_id, event_type from events where event_id = 7")
def lookup_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib
    import uuid

    r = planner.lookup_record(collection(spark, sf_dir, "events"), str(uuid.UUID(hashlib.md5(b"event:7").hexdigest())))
    return r.select("record_id", F.get_json_object("record_data", "$.event_type").alias("event_type"))


@add("lookup_entity", f"select {E} record_id, {uid('user', 'user_id')} entity_id from ({HISTORY}) where latest and not hidden and user_id = 5")
def lookup_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib
    import uuid

    c = collection(spark, sf_dir, "history")
    return planner.lookup_entity(c, str(uuid.UUID(hashlib.md5(b"user:5").hexdigest()))).select("record_id", "entity_id")


@add("lookup_field", f"select {E} record_id from events where event_id = 42")
def lookup_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.lookup_field(collection(spark, sf_dir, "events"), "seq", "42").select("record_id")


@add("flatten_index", "select '.event_type' key_name, '\"' || event_type || '\"' as value, count(*) n from events group by event_type union all select '.user_id', cast(user_id as varchar), count(*) from events group by user_id union all select '.props', null, count(*) from events union all select '.props.k', cast(json_extract(props, '$.k') as varchar) v, count(*) from events group by v union all select '.tags', null, count(*) from events union all select '.tags[]', '\"' || tag || '\"' t, count(*) from (select unnest([event_type, 'u' || (user_id % 3)]) tag from events) group by t")
def flatten_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = parsed(spark, sf_dir, "events").select(F.inline("entries"))
    kept = index.where(F.col("key_name").isin(".event_type", ".user_id", ".props", ".props.k", ".tags", ".tags[]"))
    return kept.groupBy("key_name", "value").agg(F.count(F.lit(1)).alias("n"))


@add("flatten_nested_arrays", "select '.lines' key_name, null as value, count(distinct l_orderkey) n from lineitem join orders on l_orderkey = o_orderkey union all select '.lines[]', null, count(distinct l_orderkey) from lineitem join orders on l_orderkey = o_orderkey union all select '.lines[].flag', '\"' || l_returnflag || '\"', count(*) from lineitem join orders on l_orderkey = o_orderkey group by l_returnflag union all select '.lines[].n', cast(l_linenumber as varchar), count(*) from lineitem join orders on l_orderkey = o_orderkey group by l_linenumber")
def flatten_nested_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = parsed(spark, sf_dir, "orders").select(F.inline("entries"))
    kept = index.where(F.col("key_name").isin(".lines", ".lines[]", ".lines[].flag", ".lines[].n"))
    return kept.groupBy("key_name", "value").agg(F.count(F.lit(1)).alias("n"))


@add("flatten_limits", "select count(*) n, cast(sum(case when octet_length(encode(text)) + 2 + length(text) - length(replace(replace(replace(text, '\"', ''), chr(92), ''), chr(10), '')) > 1024 then 1 else 0 end) as bigint) uncaptured from documents")
def flatten_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = parsed(spark, sf_dir, "texts").select(F.inline("entries")).where("key_name = '.text'")
    return index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("uncaptured"))


def optional_forms(each: Callable[[list[str]], str]) -> str:
    """SQL: a CASE over the forms of the records in `optional`; each: the result for a form's keys, in order."""
    forms = [("event_id % 11 = 0", ["big"]), ("event_id % 11 <> 0", [])], [("event_id % 2 = 0", ["even"]), ("event_id % 2 = 1", [])]
    return "case " + " ".join(f"when {a} and {b} then {each([*x, *y, 'record_id', 'seq', 'timestamp'])}" for a, x in forms[0] for b, y in forms[1]) + " end"


@add("shape_hash_whole", f"select {optional_forms(lambda keys: 'sha256(' + ' || '.join(f'{chr(39)}.{k}{chr(39)} || chr(10)' for k in keys) + ')')} shape_hash, count(*) n from events group by 1")
def shape_hash_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir, "optional").groupBy("shape_hash").agg(F.count(F.lit(1)).alias("n"))


OPTIONAL_VALUES = {
    "big": "'\"' || repeat('x', 1100) || '\"'",
    "even": "case when event_id % 5 = 0 then 'null' else cast(event_id % 7 as varchar) end",
    "record_id": f"'\"' || {E} || '\"'",
    "seq": "event_id",
    "timestamp": "'\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z\"'",
}


@add("record_hash_whole", f"select {E} record_id, {optional_forms(lambda keys: 'sha256(' + chr(39) + '{' + chr(39) + ' || ' + (' || ' + chr(39) + ',' + chr(39) + ' || ').join(f'{chr(39)}{chr(34)}{k}{chr(34)}:{chr(39)} || {OPTIONAL_VALUES[k]}' for k in keys) + ' || ' + chr(39) + '}' + chr(39) + ')')} record_hash from events")
def record_hash_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir, "optional").select("record_id", "record_hash")


@add("timestamp_interpret_whole", "select s.unit, event_id, case s.unit when 'rfc' then epoch_us(ts) else epoch_us(date_trunc('second', ts)) end micros from events, (values ('number_s'), ('string_s'), ('string_ms'), ('rfc')) s(unit)")
def timestamp_interpret_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpreted(read(spark, sf_dir, "events"))


def interpreted(events: DataFrame) -> DataFrame:
    """(unit, event_id, micros) of each event's time in four forms, as parsed."""
    e = events.withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"))
    forms = F.array(*(F.struct(F.lit(k).alias("unit"), v.alias("t")) for k, v in (("number_s", F.col("s")), ("string_s", F.concat(F.lit('"'), "s", F.lit('"'))), ("string_ms", F.concat(F.lit('"'), "s", F.lit('123"'))), ("rfc", F.date_format("ts", "\"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z\"'".replace('"yyyy', "'\"'yyyy"))))))
    df = e.select("event_id", F.inline(forms))
    line = F.concat(F.lit('{"id":"'), named("event", "event_id"), F.lit('","n":'), F.col("event_id").cast("string"), F.lit(',"unit":"'), "unit", F.lit('","time":'), "t", F.lit("}"))
    out = parse_lines(df.select(F.col("event_id").alias("index"), line.alias("line")), "events")
    # of milliseconds as a string, reference semantics keep 123 as nanoseconds, which rounds away
    return out.select(F.get_json_object("record_data", "$.unit").alias("unit"), F.get_json_object("record_data", "$.n").cast("long").alias("event_id"), F.unix_micros("record_timestamp").alias("micros"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item statuses of all events, in which every seventh event is stored, every 50th has another body and every 60th line is cut."""
    every = lines_of(spark, sf_dir, "events")
    lines = every.withColumn("line", F.when(F.col("index") % 60 == 59, F.substring("line", 1, 20)).otherwise(F.col("line")))
    p = staged(parse_lines(lines, "events").select(*ingest.CLASSIFIED))
    stored = parse_lines(every.where("index % 7 = 0"), "events")
    other = F.when(F.expr("index % 50 = 0"), "another").otherwise(F.col("record_hash"))
    stored = staged(stored.select("record_id", other.alias("record_hash"), F.col("record_id").alias("entity_id")))
    done = ingest.classify(p, stored)
    return done.select("index", "record_id", F.col("error_id").isNull().alias("ok"), "already_present", "inserted", "error_id")


ITEMS = f"select event_id as index, case when event_id % 60 = 59 then null else {E} end record_id, case when event_id % 60 = 59 then 'bad_record.invalid_json' when event_id % 350 = 0 then 'bad_record.reusing_id' end error_id, event_id % 7 = 0 and event_id % 50 <> 0 and event_id % 60 <> 59 already_present, event_id % 7 <> 0 and event_id % 60 <> 59 inserted from events"


#: All events, as calls of so many lines each: the runs of a call are found in one task, which a limit on its lines allows.
CALL_LINES = 2000


@add("ingest_status_whole", f"select *, error_id is null ok from ({ITEMS})")
def ingest_status_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir)


@add("ingest_summary_whole", f"select count(*) num_records, count(*) filter (error_id is null) num_ok, count(*) filter (already_present) num_already_present, count(*) filter (inserted) num_inserted, count(*) filter (error_id is not null) num_error, bool_and(error_id is null) all_ok from ({ITEMS})")
def ingest_summary_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summary(items(spark, sf_dir))


@add("ingest_ranges_whole", f"select call, min(index) as index, count(*) as count, error_id is null ok, case when error_id is null then min_by(record_id, index) end first_uuid, error_id from (select *, index // {CALL_LINES} as call, index - row_number() over (partition by index // {CALL_LINES}, error_id order by index) run from ({ITEMS})) group by call, error_id, run")
def ingest_ranges_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.status_ranges(items(spark, sf_dir).withColumn("call", F.expr(f"index div {CALL_LINES}")), "call")


@add("entity_inheritance_whole", f"select {E} record_id, {uid('user', 'user_id')} entity_id, row_number() over (partition by user_id order by ts, event_id) rank from events")
def entity_inheritance_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version against the one it supersedes, along each entity's chain; the first keeps the id it states."""
    versions = staged(parsed(spark, sf_dir, "history").select(*ingest.CLASSIFIED))
    rank = F.row_number().over(Window.partitionBy("explicit_entity_id").orderBy("record_timestamp", "index")).cast("long")
    ranked = versions.withColumn("rank", rank)
    superseded = versions.join(versions.select(F.col("supersedes_id").alias("record_id")), "record_id", "left_semi")
    stored = superseded.select("record_id", "record_hash", F.col("explicit_entity_id").alias("entity_id"))
    # as if later versions had no entity id of their own
    bare = ranked.withColumn("explicit_entity_id", F.when(F.col("supersedes_id").isNull(), F.col("explicit_entity_id")))
    return ingest.classify(bare, stored).select("record_id", "entity_id", "rank")


@add("superseded_view", f"select {E} record_id, not latest is_superseded from ({HISTORY})")
def superseded_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(spark, sf_dir, "history").records.select("record_id", "is_superseded")


@add("upsert_outcome", f"select {E} record_id, {uid('user', 'user_id')} entity_id, case when before is null then 'created' when before = event_type then 'unchanged' else 'updated' end outcome from (select *, lag(event_type) over (partition by user_id order by ts, {E}) before from events)")
def upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = parsed(spark, sf_dir, "history")
    content = F.md5(F.get_json_object("record_data", "$.event_type").cast("binary"))
    return ingest.upsert_outcomes(h.select(F.col("explicit_entity_id").alias("entity_id"), "record_id", "record_timestamp", content.alias("content_hash")))


@add("key_dictionary", "select key_name from (values ('.big'), ('.even'), ('.record_id'), ('.seq'), ('.timestamp')) t(key_name)")
def key_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(spark, sf_dir, "optional").keys


@add("stats", "select count(*) records, 10 as keys, 11 * count(*) index_rows, 11.0::double index_rows_per_record from events")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planner.stats(collection(spark, sf_dir, "events"))
    return out.select("records", F.col("keys").cast("int").alias("keys"), "index_rows", "index_rows_per_record")


@add("manifest_delta_whole", "select 'f' || event_id path, event_id size from events where event_id % 2 = 1 or event_id % 6 = 0")
def manifest_delta_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_files(read(spark, sf_dir, "events"))


def changed_files(events: DataFrame) -> DataFrame:
    """(path, size) of a file per event that the manifest lacks: it knows the even ones, every third of these by another size."""
    from stratadoc.streaming.sync import new_files

    files = events.select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("mtime"), F.col("event_id").alias("size"))
    known = files.where("size % 2 = 0").withColumn("size", F.when(F.col("size") % 6 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("target", F.lit("t"))
    return new_files(files, known, "t").select("path", "size")


#: Lines of one length, so that SQL knows where the splitter cuts: BATCH_LINES of them and their line ends.
FILE_EVENTS, BATCH_LINES, SEQ_DIGITS = 100_000, 500, 20
BATCHED = f"select event_type, event_id // {FILE_EVENTS} as part, event_id, '{{\"seq\":\"' || lpad(cast(event_id as varchar), {SEQ_DIGITS}, '0') || '\"}}' line, (row_number() over (partition by event_type, event_id // {FILE_EVENTS} order by event_id) - 1) // {BATCH_LINES} as batch from events"


@add("batch_digest_whole", f"select event_type, cast(part as bigint) part, cast(batch as bigint) batch, batch = max(batch) over (partition by event_type, part) final, n, digest from (select event_type, part, batch, count(*) n, sha256(string_agg(line, chr(10) order by event_id)) digest from ({BATCHED}) group by event_type, part, batch)")
def batch_digest_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as JSONL files by type and id range, cut into bounded batches by the splitter of directory syncs."""
    import uuid

    from stratadoc.config import Limits
    from stratadoc.plans.builders import base_folder
    from stratadoc.sources.jsonl import file_batches

    folder = f"{base_folder(spark)}/batches-{uuid.uuid4().hex}"
    line = F.concat(F.lit('{"seq":"'), F.lpad(F.col("event_id").cast("string"), SEQ_DIGITS, "0"), F.lit('"}'))
    e = read(spark, sf_dir, "events").select("event_type", F.expr(f"event_id div {FILE_EVENTS}").alias("part"), "event_id", line.alias("value"))
    e.repartition("event_type", "part").sortWithinPartitions("event_type", "part", "event_id").drop("event_id").write.partitionBy("event_type", "part").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    width = len('{"seq":""}') + SEQ_DIGITS
    cut = file_batches(files, Limits(sync_batch_bytes=BATCH_LINES * (width + 1) - 1))
    n = F.size(F.split("payload", "\n")).cast("long").alias("n")
    return cut.select(F.regexp_extract("path", "/event_type=([^/]*)/", 1).alias("event_type"), F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long").alias("part"), F.col("batch").cast("long").alias("batch"), "final", n, "digest")


def queries() -> dict[str, Query]:
    import stratadoc.plans.writes  # noqa: F401  (adds its queries to these)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    import stratadoc.plans.writes  # noqa: F401

    return dict(_sql)
