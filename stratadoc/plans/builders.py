"""Document collections made of the driver's tables, ingested once per session into a store and then queried."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.config import Config, Limits
from stratadoc.operators.ingest import ingest_lines
from stratadoc.operators.metadata import parse_lines
from stratadoc.plans.planner import Collection
from stratadoc.sources.store import Store

CONFIG = Config(namespaces=("events", "orders", "conversations", "texts", "history", "optional", "wide", "locked", "versions"))
_stores: dict[tuple[str, str], Store] = {}


def uid(text: Column) -> Column:
    return F.regexp_replace(F.md5(text.cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def named(prefix: str, column: str) -> Column:
    return uid(F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string")))


def iso(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lines_of(spark: SparkSession, sf_dir: str, namespace: str) -> DataFrame:
    """(index, line) of a namespace's documents."""
    if namespace == "events":
        e = read(spark, sf_dir, "events")
        doc = F.struct(named("event", "event_id").alias("record_id"), iso("ts").alias("timestamp"), F.col("event_id").alias("seq"), "user_id", "event_type", "value", F.from_json("props", "k long").alias("props"), F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))).alias("tags"))
        return e.select(F.col("event_id").alias("index"), F.to_json(doc).alias("line"))
    if namespace == "optional":  # `even` only on every other event, null on every fifth of these; `big` above the value limit on some
        e = read(spark, sf_dir, "events")
        even = F.when(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 5 == 0, F.lit(',"even":null')).otherwise(F.concat(F.lit(',"even":'), (F.col("event_id") % 7).cast("string")))).otherwise("")
        big = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit(',"big":"'), F.repeat(F.lit("x"), 1100), F.lit('"'))).otherwise("")
        line = F.concat(F.lit('{"record_id":"'), named("event", "event_id"), F.lit('","timestamp":"'), iso("ts"), F.lit('","seq":'), F.col("event_id").cast("string"), even, big, F.lit("}"))
        return e.select(F.col("event_id").alias("index"), line.alias("line"))
    if namespace == "orders":
        lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")))).alias("lines"))
        o = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
        doc = F.struct(named("order", "o_orderkey").alias("record_id"), iso("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "lines")
        return o.select(F.col("o_orderkey").alias("index"), F.to_json(doc).alias("line"))
    if namespace == "conversations":
        turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        time = iso(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60))
        doc = F.struct(named("conv", "conv_id").alias("record_id"), time.alias("timestamp"), "conv_id", "turns")
        return turns.select(F.col("conv_id").alias("index"), F.to_json(doc).alias("line"))
    if namespace == "texts":
        doc = F.struct(named("doc", "doc_id").alias("record_id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), "doc_id", "lang", "source", "n_chars", "text")
        return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.to_json(doc).alias("line"))
    if namespace == "history":
        from pyspark.sql import Window

        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = read(spark, sf_dir, "events").withColumn("before", F.lag("event_id").over(w))
        deleted = F.when(F.col("event_id") % 10 == 9, F.lit(True))
        doc = F.struct(named("event", "event_id").alias("record_id"), iso("ts").alias("timestamp"), named("user", "user_id").alias("entity_id"), F.when(F.col("before").isNotNull(), named("event", "before")).alias("supersedes_id"), "event_type", deleted.alias("_deletion_marker"))
        return e.select(F.col("event_id").alias("index"), F.to_json(doc).alias("line"))
    if namespace == "wide":  # 1500 keys over all records
        e = read(spark, sf_dir, "events")
        line = F.concat(F.lit('{"id":"'), named("event", "event_id"), F.lit('","time":"'), iso("ts"), F.lit('","k'), F.lpad((F.col("event_id") % 1500).cast("string"), 4, "0"), F.lit('":1}'))
        return e.select(F.col("event_id").alias("index"), line.alias("line"))
    if namespace == "locked":  # a third is locked until long after the queries' time, a third until before it
        e = read(spark, sf_dir, "events")
        lock = F.when(F.col("event_id") % 3 == 0, "2030-01-01T00:00:00Z").when(F.col("event_id") % 3 == 1, "2020-01-01T00:00:00Z")
        doc = F.struct(named("event", "event_id").alias("record_id"), iso("ts").alias("timestamp"), "event_type", lock.alias("locked_until"))
        return e.select(F.col("event_id").alias("index"), F.to_json(doc).alias("line"))
    raise KeyError(namespace)


def parsed(spark: SparkSession, sf_dir: str, namespace: str, limits: Limits = Limits()) -> DataFrame:
    return parse_lines(lines_of(spark, sf_dir, namespace), namespace, limits)


def base_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="store-")
    return base.rstrip("/")


def staged(rows: DataFrame) -> DataFrame:
    """The rows, written and read back: made once, and of a size that the optimizer knows. What it expects of parsed lines
    follows from their compressed source and is far too little, so that it would broadcast whole tables."""
    folder = f"{base_folder(rows.sparkSession)}/staged-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def new_store(spark: SparkSession, name: str, config: Config = CONFIG) -> Store:
    return Store(spark, f"{base_folder(spark)}/store-{name}-{uuid.uuid4().hex}", config)


def store_of(spark: SparkSession, sf_dir: str, namespace: str) -> Store:
    """The store that holds the namespace, ingested by one call at its first use in this session; history as if each of its
    versions had been sent by itself."""
    key = (spark.sparkContext.applicationId, sf_dir, namespace)
    if key not in _stores:
        store = new_store(spark, namespace)
        ingest_lines(store, namespace, lines_of(spark, sf_dir, namespace), at_once=namespace == "history")
        store.drop_staging()
        _stores[key] = store
    return _stores[key]


def collection(spark: SparkSession, sf_dir: str, namespace: str, semantics: str = "reference") -> Collection:
    return store_of(spark, sf_dir, namespace).collection(namespace, semantics)
