"""JSONL sources: directories, single files' batches, request bodies and driver-side lists."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.config import Limits
from stratadoc.errors import EngineError

# Which files a directory source takes.
FILE_PATTERN = r".*[.](jsonl|jsonlines)$"
EXCLUDED_SUFFIXES = (".tmp", ".sqlite3", ".sqlite3-journal", ".sqlite", ".sqlite-journal", ".yaml", ".yml")


def lines_frame(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(index, line) of lines that the caller holds."""
    return spark.createDataFrame(list(enumerate(lines)), "index long, line string")


def body_lines(body: str, limits: Limits = Limits(), semantics: str = "reference") -> list[str]:
    """The lines of a request body, blank ones included; too many are refused. In reference semantics a line over the limit ends
    the scan; in intended semantics it is an item of its own, which parsing refuses as too long."""
    lines = body.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    kept = []
    for line in lines:
        if semantics == "reference" and len(line.encode()) > limits.line_bytes:
            break
        kept.append(line.removesuffix("\r"))
    if len(kept) > limits.request_lines:
        raise EngineError("unknown_error", "too many lines")
    return kept


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(index, line) of a JSONL file or folder; index is unique and rises within a file, but has gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("index"), F.col("value").alias("line"))


def directory_files(spark: SparkSession, folder: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """(path, mtime, size) of the JSONL files under a folder, by their base names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    files = files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    keep = F.regexp_like(base, F.lit(f"^(?:{pattern})$"))
    for suffix in EXCLUDED_SUFFIXES:
        keep = keep & ~F.endswith(F.lower(base), F.lit(suffix))
    return files.where(keep)


def batches_of(lines: Iterator[str], most_bytes: int) -> Iterator[tuple[list[str], bool]]:
    """Trimmed non-blank lines in batches of up to most_bytes when joined; the last one is final, even if empty."""
    held, size = [], 0
    for line in lines:
        line = line.strip()
        if not line:
            continue
        n = len(line.encode()) + bool(held)
        if held and size + n > most_bytes:
            yield held, False
            held, size, n = [], 0, n - 1
        held.append(line)
        size += n
    yield held, True


def batch_digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


BATCH_SCHEMA = "path string, batch int, final boolean, digest string, payload string"


def file_batches(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The batches of each file of files(path): number, whether it is the last, SHA-256 and text.

    A file is read line by line within one task, as its batches depend on all lines before.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for part in parts:
            for path in part.column(0).to_pylist():
                uri = re.sub(r"^file:/+", "file:///", path)
                system, name = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(name, compression=None) as stream:
                    for k, (lines, final) in enumerate(batches_of(stream_lines(stream), limits.sync_batch_bytes)):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int32()), pa.array([final]), pa.array([batch_digest(lines)]), pa.array(["\n".join(lines)])], names=["path", "batch", "final", "digest", "payload"])

    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, BATCH_SCHEMA)


def stream_lines(stream, chunk: int = 1 << 20) -> Iterator[str]:
    held = b""
    while piece := stream.read(chunk):
        *lines, held = (held + piece).split(b"\n")
        for line in lines:
            yield line.decode("utf-8", "replace")
    if held:
        yield held.decode("utf-8", "replace")
