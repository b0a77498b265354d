"""Token-id files: independent zstandard frames, a trailing seek table, and a checksum for each frame.

File layout (all integers little-endian):

* frames, one after another; a frame holds the ids of consecutive documents as uint16 or uint32 and is
  compressed by itself, with zstandard's own content checksum switched on;
* a skippable frame (magic 0x184D2A5E) with the seek table: for each document its id, a null flag, the frame,
  the first id within the frame and the number of ids; for each frame its offset, compressed size, raw size
  and the XXH64 of its compressed bytes;
* a footer inside that skippable frame: counts, id width and a magic word, so that a reader finds the table
  from the end of the file and then decompresses only the frames of the documents that it was asked for.

Since the seek table is a skippable frame, any zstandard decoder can still read the whole file as a stream.

Cases: a null or empty text holds only the end id. Rows with equal doc_id stay separate rows, in the order of
their texts; a null doc_id comes first. An empty table gives no file and no row. Further columns are not
read. Texts are encoded whole, however long; a document never spans two frames.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratadoc.llm.bpe import encoder, tokenizer_path
from stratadoc.llm.shared import filesystem, one_task_a_file, shared_folder, texts_of

SKIPPABLE_MAGIC = 0x184D2A5E
FOOTER = struct.Struct("<QQBxxxxxxx8s")
FOOTER_MAGIC = b"TOKSEEK1"
DOC_ENTRY = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])
FRAME_ENTRY = np.dtype([("offset", "<u8"), ("packed", "<u8"), ("raw", "<u8"), ("xxh64", "<u8")])
MANIFEST_SCHEMA = "path string, part long, seq long, n_docs long, n_tokens long, n_bytes long"
READ_SCHEMA = "path string, doc_id long, start long, n_tokens long, ids binary"


class FileWriter:
    """Writes one file; ids are buffered for a frame at a time."""

    def __init__(self, stream, id_bytes: int, frame_ids: int):
        import zstandard

        self.stream, self.dtype, self.frame_ids = stream, np.dtype(f"<u{id_bytes}"), frame_ids
        self._packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self._parts: list[np.ndarray] = []
        self._held = 0
        self._docs: list[tuple] = []
        self._frames: list[tuple] = []
        self.offset = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"id {int(ids.max())} does not fit into {self.dtype.itemsize} bytes")
        self._docs.append((doc_id or 0, doc_id is None, len(self._frames), self._held, len(ids)))
        self._parts.append(ids.astype(self.dtype))
        self._held += len(ids)
        self.n_tokens += len(ids)
        if self._held >= self.frame_ids:
            self._close_frame()

    def _close_frame(self) -> None:
        import xxhash

        if not self._parts:
            return
        raw = np.concatenate(self._parts).tobytes()
        packed = self._packer.compress(raw)
        self.stream.write(packed)
        self._frames.append((self.offset, len(packed), len(raw), xxhash.xxh64_intdigest(packed)))
        self.offset += len(packed)
        self._parts, self._held = [], 0

    def close(self) -> int:
        self._close_frame()
        table = np.array(self._docs, DOC_ENTRY).tobytes() + np.array(self._frames, FRAME_ENTRY).tobytes()
        body = table + FOOTER.pack(len(self._docs), len(self._frames), self.dtype.itemsize, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.stream.close()
        return self.offset + 8 + len(body)

    @property
    def n_docs(self) -> int:
        return len(self._docs)


class FileReader:
    """Reads the seek table, then only those frames that are asked for; every frame's checksum is verified."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - FOOTER.size)
        n_docs, n_frames, width, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != FOOTER_MAGIC:
            raise ValueError("not a token file: no footer")
        self.dtype = np.dtype(f"<u{width}")
        head = n_docs * DOC_ENTRY.itemsize
        stream.seek(size - FOOTER.size - head - n_frames * FRAME_ENTRY.itemsize)
        self.docs = np.frombuffer(stream.read(head), DOC_ENTRY)
        self.frames = np.frombuffer(stream.read(n_frames * FRAME_ENTRY.itemsize), FRAME_ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.docs["n"].astype(np.int64))])
        self.frames_read = 0

    def frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        f = self.frames[k]
        self.stream.seek(int(f["offset"]))
        packed = self.stream.read(int(f["packed"]))
        if xxhash.xxh64_intdigest(packed) != int(f["xxh64"]):
            raise ValueError(f"frame {k} is damaged")
        self.frames_read += 1
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(f["raw"])), self.dtype)

    def documents(self, wanted: set[int | None] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, ids), in file order; wanted: only these, None for all."""
        held, ids = -1, np.empty(0, self.dtype)
        for i, d in enumerate(self.docs):
            doc_id = None if d["is_null"] else int(d["doc_id"])
            if wanted is not None and doc_id not in wanted:
                continue
            if held != (k := int(d["frame"])):
                held, ids = k, self.frame(k)
            yield doc_id, int(self.starts[i]), ids[int(d["first"]) : int(d["first"]) + int(d["n"])]


def write_token_files(df: DataFrame, folder: str, path: str | None = None, end_id: int = 0, id_bytes: int = 2, frame_ids: int = 1 << 18, file_ids: int = 1 << 26) -> DataFrame:
    """Encodes df(doc_id, text) in ascending doc_id order into files under folder; returns their manifest.

    The rows are range-partitioned by doc_id and sorted within each partition; each task writes its own
    files, of file_ids ids or a little more. A file's name is new in each attempt, and only files that the manifest
    names count, so a task that runs twice does no harm. Take the manifest from a written table
    (see `store_tokens`), as evaluating it again writes new files.
    """
    path = path or tokenizer_path()
    ordered = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        encode, part = encoder(path).encode_all, TaskContext.get().partitionId()
        out, name, seq = None, "", 0

        def closed():
            size = out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "part": [part], "seq": [seq], "n_docs": [out.n_docs], "n_tokens": [out.n_tokens], "n_bytes": [size]})

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts_of(batch.column(1)), end_id), strict=True):
                if out is None:
                    name = f"tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.zst"
                    out = FileWriter(system.open_output_stream(f"{root}/{name}", compression=None), id_bytes, frame_ids)
                out.add(doc_id, ids)
                if out.n_tokens >= file_ids:
                    yield closed()
                    out, seq = None, seq + 1
        if out is not None:
            yield closed()

    return ordered.mapInArrow(write, MANIFEST_SCHEMA)


def store_tokens(spark: SparkSession, df: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the files and their manifest table; returns the manifest with `base`, the ids in all files before."""
    folder = folder or shared_folder(spark, "tokens")
    write_token_files(df, f"{folder}/files", **options).write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")
    # one row per file of up to file_ids ids: the running sum is over files, not documents
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, wanted: set[int | None] | None = None, with_ids: bool = True) -> DataFrame:
    """Rows (path, doc_id, start, n_tokens, ids) from the files that the manifest (path, base) names.

    start counts the ids of all documents before; ids are little-endian unsigned 32-bit integers. With
    `wanted`, only those documents' frames are decompressed. with_ids=False leaves the ids' crc32 in ids, as
    4 bytes.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = filesystem(path)
                held: dict[str, list] = {k: [] for k in ("path", "doc_id", "start", "n_tokens", "ids")}
                size = 0
                with system.open_input_file(name) as stream:
                    for doc_id, start, ids in FileReader(stream, stream.size()).documents(wanted):
                        raw = ids.astype("<u4").tobytes()
                        raw = raw if with_ids else struct.pack("<I", zlib.crc32(raw))
                        for column, value in zip(held.values(), (path, doc_id, base + start, len(ids), raw), strict=True):
                            column.append(value)
                        size += len(raw)
                        if size > 8 << 20 or len(held["path"]) >= 10_000:
                            yield read_batch(held)
                            size = 0
                            for column in held.values():
                                column.clear()
                yield read_batch(held)

    return one_task_a_file(manifest.select("path", "base")).mapInArrow(read, READ_SCHEMA)


def read_batch(held: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(held.values(), kinds, strict=True)], names=list(held))


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, start, n_tokens, ids_crc32, read back from the files."""
    read = read_token_files(store_tokens(spark, docs), with_ids=False)
    crc = F.conv(F.concat(*(F.hex(F.substring("ids", i, 1)) for i in (4, 3, 2, 1))), 16, 10).cast("long")
    return read.select("doc_id", "start", "n_tokens", crc.alias("ids_crc32"))
