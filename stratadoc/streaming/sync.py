"""Incremental directory ingestion: files that grew or are new, cut into batches by content, each sent once and in order.

The state is in the store's own tables: synced_batches by (digest, target), written in the same commit as the records they
stand for, and synced_files by (path, mtime, size, target), once all batches of a file are in. A growing file keeps
the digests of its full leading batches, so only its tail is read as new; records of it that are known are found by the
record-level check.

Batches are sent in the order of path and number. Consecutive ones are tried as one commit, at first of up to `sync_group_bytes`
and of twice as much after each that went in, so that a large folder takes few commits, each of which looks at the store; if a
call is refused, or if a record of it supersedes another, its halves are sent instead, down to single batches. So each batch
has the outcome that it would have had by itself, and one that is refused holds up neither the others nor later passes,
which try it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.errors import EngineError
from stratadoc.operators.ingest import IngestResult, ingest_lines
from stratadoc.sources.jsonl import FILE_PATTERN, directory_files, file_batches
from stratadoc.sources.store import Store


def new_files(files: DataFrame, synced: DataFrame, target: str) -> DataFrame:
    """Files whose (path, mtime, size) the manifest lacks for the target."""
    known = synced.where(F.col("target") == target).select("path", "mtime", "size")
    return files.join(known, ["path", "mtime", "size"], "left_anti")


def new_batches(batches: DataFrame, synced: DataFrame, target: str) -> DataFrame:
    """Batches with text whose digest the manifest lacks for the target; of equal ones, the first."""
    known = synced.where(F.col("target") == target).select("digest")
    fresh = batches.where("payload != ''").join(known, "digest", "left_anti")
    first = fresh.groupBy("digest").agg(F.min(F.struct("path", "batch")).alias("first")).select("first.path", "first.batch")
    return fresh.join(first, ["path", "batch"], "left_semi").select(*batches.columns)


def batch_lines(batches: DataFrame) -> DataFrame:
    """(index, line) of the texts of batches(place, payload), in the order of their places."""
    lines = batches.select("place", F.posexplode(F.split("payload", "\n")).alias("line_place", "line"))
    return lines.select((F.shiftleft(F.col("place").cast("long"), 32) + F.col("line_place")).alias("index"), "line")


@dataclass
class SyncResult:
    """The outcome of a pass: of each commit, and (path, batch, error_id) of the batches that were refused."""

    commits: list[IngestResult]
    errors: list[dict]

    def summary(self) -> dict:
        parts = [c.summary() for c in self.commits]
        names = ("num_records", "num_ok", "num_already_present", "num_inserted", "num_error")
        return {**{n: sum(p[n] for p in parts) for n in names}, "all_ok": all(p["all_ok"] for p in parts) and not self.errors}


def groups_of(headers: Iterable, most_bytes: Callable[[], int]) -> Iterator[list]:
    """Consecutive headers of up to most_bytes together, as asked anew for each, at least one."""
    held, size = [], 0
    for h in headers:
        if held and size + h.size > most_bytes():
            yield held
            held, size = [], 0
        held.append(h)
        size += h.size
    if held:
        yield held


def sync_directory(store: Store, namespace: str, folder: str, target: str | None = None, pattern: str = FILE_PATTERN) -> SyncResult | None:
    """One pass over a folder; None if nothing is new. target: by default the store and namespace."""
    spark, target = store.spark, target or f"{store.root}/{namespace}"
    files = new_files(directory_files(spark, folder, pattern), store.read("synced_files", namespace), target)
    staged = store.staging(store.next_commit(), f"sync-{uuid.uuid4().hex}")
    files.write.parquet(f"{staged}-files")
    files = spark.read.parquet(f"{staged}-files")
    if not files.limit(1).count():
        return None
    every = file_batches(files, store.config.limits)
    new_batches(every, store.read("synced_batches", namespace), target).repartitionByRange("path", "batch").sortWithinPartitions("path", "batch").write.parquet(f"{staged}-batches")
    batches = spark.read.parquet(f"{staged}-batches")
    where = (F.lit(target).alias("target"), F.lit(namespace).alias("namespace"))
    commits, errors = [], []
    room = store.config.limits.sync_group_bytes

    def send(group: list, last: bool) -> None:
        nonlocal room
        places = spark.createDataFrame([(h.path, h.batch, k) for k, h in enumerate(group)], "path string, batch int, place int")
        # the range of paths lets the scan skip row groups
        part = batches.where(F.col("path").between(group[0].path, group[-1].path)).join(F.broadcast(places), ["path", "batch"])
        also = {"synced_batches": part.select("digest", *where)}
        if last and not errors:
            also["synced_files"] = files.select("path", "mtime", "size", *where)
        try:
            commits.append(ingest_lines(store, namespace, batch_lines(part), also=also, apart=len(group) > 1))
            room *= 2
        except EngineError as e:
            room = store.config.limits.sync_group_bytes
            if len(group) == 1:
                errors.append({"path": group[0].path, "batch": group[0].batch, "error_id": e.error_id})
                return
            half = len(group) // 2
            send(group[:half], False)
            send(group[half:], last)
            room = store.config.limits.sync_group_bytes

    headers = batches.select("path", "batch", F.octet_length("payload").alias("size")).orderBy("path", "batch").toLocalIterator()
    held: list | None = None
    for group in groups_of(headers, lambda: room):
        if held is not None:
            send(held, False)
        held = group
    if held is not None:
        send(held, True)
    if held is None or errors:
        # files without a new batch, or, where a batch was refused, all other files
        refused = spark.createDataFrame([(p,) for p in sorted({e["path"] for e in errors})], "path string")
        whole = files.join(refused, "path", "left_anti").select("path", "mtime", "size", *where)
        commits.append(ingest_lines(store, namespace, spark.createDataFrame([], "index long, line string"), also={"synced_files": whole}))
    system = store.filesystem()
    for name in ("files", "batches"):
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{staged}-{name}"), True)
    return SyncResult(commits, errors)


def watch_directory(store: Store, namespace: str, folder: str, checkpoint: str, seconds: int | None = None, pattern: str = FILE_PATTERN):
    """A streaming query that syncs the folder at once and then every so many seconds.

    A rate source is only the clock; what is new is decided by the manifest, so files that grow are taken up,
    which a file source would not do, and a restart sends nothing twice.
    """
    seconds = seconds or store.config.limits.debounce_seconds
    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_: DataFrame, __: int) -> None:
        sync_directory(store, namespace, folder, pattern=pattern)

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def stream_lines(store: Store, namespace: str, lines: DataFrame, checkpoint: str, name: str, available_now: bool = True):
    """A streaming query that ingests a streaming DataFrame(line): each micro-batch is a named batch of the ledger, sent once."""

    def send(rows: DataFrame, epoch: int) -> None:
        batch = f"{name}-{epoch}"
        known = store.read("processed_batches", namespace).where(F.col("batch_name") == batch)
        if not known.limit(1).count() and rows.limit(1).count():
            ingest_lines(store, namespace, rows.select(F.monotonically_increasing_id().alias("index"), "line"), batch)

    writer = lines.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
