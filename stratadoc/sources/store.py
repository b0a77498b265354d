"""The store: Parquet tables under one folder, with commits that readers see whole or not at all.

A commit writes its files under `<table>/commit=<n>/` and then creates the marker `_commits/<n>`; readers take
only the folders of commits that have their marker. Any file system that Spark writes to will do. One writer at a
time is assumed. Flags such as "superseded" are derived when read, as files are never changed: a commit lists the records
that it supersedes in a narrow table of its own.

`compact` rewrites all commits of the tables into one base folder per table, which becomes visible with its own marker; readers
take the newest base and the commits after it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.config import Config
from stratadoc.plans.planner import Collection

SCHEMAS = {
    "records": "record_id string, entity_id string, record_timestamp timestamp, record_hash string, shape_hash string, content_hash string, record_data string, locked_until timestamp, supersedes_id string, is_deletion_marker boolean, commit int, namespace string",
    # a superseded record's id and where its successor was stored; at_once: it counts within the same commit, too
    "superseded": "record_id string, by_record_id string, at_once boolean, commit int, namespace string",
    # the versions of entities that are not named as their first record
    "entities": "entity_id string, record_id string, record_timestamp timestamp, is_deletion_marker boolean, commit int, namespace string",
    # index rows by path, summed over the records of a commit
    "key_counts": "key_name string, n long, commit int, namespace string",
    "field_index": "key_name string, record_id string, value string, commit int, namespace string",
    "field_keys": "key_name string, commit int, namespace string",
    "processed_batches": "batch_name string, batch_timestamp timestamp, commit int, namespace string",
    "synced_files": "path string, mtime timestamp, size long, target string, commit int, namespace string",
    "synced_batches": "digest string, target string, commit int, namespace string",
}
VERSION = 2
#: A commit of so many records at most writes a file per table.
FEW_RECORDS = 1000
#: How the files of a table are clustered, so that a lookup reads few row groups.
CLUSTERED = {"records": ("record_id",), "entities": ("entity_id",), "field_index": ("key_name", "value")}


class Store:
    def __init__(self, spark: SparkSession, root: str, config: Config = Config()):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        self._write_text("_version.json", json.dumps({"version": VERSION}), keep=True)
        found = json.loads(self._read_text("_version.json"))["version"]
        if found != VERSION:
            raise ValueError(f"the store at {root} has layout version {found}; this program reads version {VERSION}")

    # files through Spark's own file system layer, so that any store works

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def filesystem(self):
        return self.path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write_text(self, name: str, text: str, keep: bool = False) -> None:
        path, system = self.path(name), self.filesystem()
        if keep and system.exists(path):
            return
        partial = self.path(f"{name}.partial")
        out = system.create(partial, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not system.rename(partial, path):
            raise OSError(f"{path} is there already: another writer has committed")

    def _read_text(self, name: str) -> str:
        stream = self.filesystem().open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        path, system = self.path(folder), self.filesystem()
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def commits(self) -> list[int]:
        return sorted(int(n) for n in self._names("_commits") if n.isdigit())

    def base(self) -> int:
        """The last commit that the newest base holds; 0 if there is none."""
        return max((int(n) for n in self._names("_bases") if n.isdigit()), default=0)

    def next_commit(self) -> int:
        return max(self.commits(), default=0) + 1

    def read(self, table: str, namespace: str | None = None) -> DataFrame:
        schema, base = SCHEMAS[table], self.base()
        # two listings, however many commits there are
        there = set(self._names(table))
        paths = [f"{self.root}/{table}/commit={n}" for n in self.commits() if n > base and f"commit={n}" in there]
        out = None
        if paths:
            out = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)
        if base and (folder := f"base-{base}") in set(self._names(table)):
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{folder}")
            out = rows if out is None else rows.unionByName(out)
        if out is None:
            out = self.spark.createDataFrame([], schema)
        return out if namespace is None else out.where(F.col("namespace") == namespace)

    def holds(self, table: str) -> bool:
        """Whether a reader finds files of the table."""
        there, base = set(self._names(table)), self.base()
        return f"base-{base}" in there or any(n > base and f"commit={n}" in there for n in self.commits())

    def compact(self) -> int:
        """Rewrites every table into one clustered folder; returns the last commit that it holds. Files that it replaces stay
        until `clean`, as readers may be at them."""
        last = max(self.commits(), default=0)
        if last <= self.base():
            return self.base()
        for table, schema in SCHEMAS.items():
            rows = clustered(table, self.read(table))
            if rows.limit(1).count():
                rows.select(*(c.split()[0] for c in schema.split(", "))).write.mode("overwrite").option("compression", "zstd").partitionBy("namespace").parquet(f"{self.root}/{table}/base-{last}")
        self._write_text(f"_bases/{last}", json.dumps({"base": last}))
        return last

    def clean(self) -> int:
        """Deletes what no reader that starts now will look at: staging, commits without a marker, and folders that a base has
        replaced. Not while a writer is at work. Returns the number of folders deleted."""
        system, base, marked, n = self.filesystem(), self.base(), set(self.commits()), 0
        for table in SCHEMAS:
            for name in self._names(table):
                kind, _, number = name.replace("base-", "base=").partition("=")
                old = (kind == "commit" and (int(number) not in marked or int(number) <= base)) or (kind == "base" and int(number) < base)
                if old:
                    n += bool(system.delete(self.path(f"{table}/{name}"), True))
        self.drop_staging()
        return n

    def append(self, commit: int, table: str, rows: DataFrame, n_records: int | None = None) -> None:
        """Adds rows (with namespace) to a commit that is not marked yet; n_records: of how many records they are, if known."""
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ") if c.split()[0] != "commit"]
        rows = rows.select(*columns)
        rows = sorted_rows(table, rows, few=n_records is not None and n_records <= FEW_RECORDS)
        rows.write.mode("append").option("compression", "zstd").partitionBy("namespace").parquet(f"{self.root}/{table}/commit={commit}")

    def mark(self, commit: int) -> None:
        self._write_text(f"_commits/{commit}", json.dumps({"commit": commit}))

    def staging(self, commit: int, name: str) -> str:
        return f"{self.root}/_staging/{commit}-{name}"

    def drop_staging(self) -> None:
        self.filesystem().delete(self.path("_staging"), True)

    def collection(self, namespace: str, semantics: str | None = None) -> Collection:
        self.config.check_namespace(namespace)
        stored = self.read("records", namespace)
        if self.holds("superseded"):
            records = with_superseded(stored, self.read("superseded", namespace), semantics or self.config.semantics)
        else:
            records = stored.withColumn("is_superseded", F.lit(False))
        keys = self.read("field_keys", namespace).select("key_name").distinct()
        return Collection(self.spark, namespace, records, self.read("field_index", namespace), keys, stored, self.read("entities", namespace), self.read("key_counts", namespace))

    def sizes(self) -> dict[str, int]:
        """Bytes on the file system by table."""
        system = self.filesystem()
        return {t: (system.getContentSummary(self.path(t)).getLength() if system.exists(self.path(t)) else 0) for t in SCHEMAS}


def sorted_rows(table: str, rows: DataFrame, few: bool = False) -> DataFrame:
    """The rows of a commit, each task's in the order of what their table is looked up by: the row groups and pages of a file are
    skipped by their ranges, and nothing is shuffled. Few rows make one file."""
    if table not in CLUSTERED:
        return rows
    return (rows.coalesce(1) if few else rows).sortWithinPartitions("namespace", *CLUSTERED[table])


def clustered(table: str, rows: DataFrame) -> DataFrame:
    """The rows in ranges of what their table is looked up by, for a base. Rows of one path and value, which may be most
    of an index, are dealt by their ids."""
    if table not in CLUSTERED:
        return rows
    keys = ("namespace", *CLUSTERED[table])
    return rows.repartitionByRange(*dict.fromkeys((*keys, "record_id"))).sortWithinPartitions(*keys)


def with_superseded(records: DataFrame, superseded: DataFrame, semantics: str = "reference") -> DataFrame:
    """records with is_superseded: a later commit (in intended semantics, any) holds a record that supersedes it.

    The list of superseded ids is narrow and only as long as the number of old versions.
    """
    last = F.max("commit").alias("_superseded_in")
    marks = superseded.groupBy("record_id").agg(last, F.max(F.coalesce("at_once", F.lit(False))).alias("_at_once"))
    flag = F.col("_superseded_in").isNotNull() if semantics == "intended" else F.coalesce((F.col("_superseded_in") > F.col("commit")) | F.col("_at_once"), F.lit(False))
    return records.join(marks, "record_id", "left").withColumn("is_superseded", flag).drop("_superseded_in", "_at_once")


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} PiB"

