"""What the corpus operators share: table access, the shared folder, Arrow helpers and hash splits."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_ROOT = str(Path(__file__).resolve().parents[2])


def make_importable(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver was not started in its folder."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, REPO_ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent and the master is local (as in tests), a temporary folder is made
    and registered as the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}" if spark.sparkContext.master.startswith("local") else base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI; works for file, hdfs, s3 and gs URIs on any machine."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def hash_fold(column: str, folds: int = 5) -> Column:
    """crc32(column as text) mod folds; rows without a value fall in the fold of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def placed(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """(df with its columns named c0, c1, ..., the new names of `names`): no column of the input clashes with one that is
    added, whatever it is called. `done.toDF(*df.columns)` gives the old names back. A name is matched exactly, or else
    without regard to case."""
    lower = [c.lower() for c in df.columns]
    found = [f"c{df.columns.index(n) if n in df.columns else lower.index(n.lower())}" for n in names]
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), found


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; a null counts as the empty text."""
    return [t if t is not None else "" for t in column.to_pylist()]


def one_task_a_file(manifest: DataFrame) -> DataFrame:
    """The manifest's rows dealt to as many tasks: its own size in bytes would let them all be merged into one."""
    return manifest.repartition(max(1, manifest.count()))


def slices_by_bytes(lengths, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive rows of about `most` bytes together, at least one row each."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
