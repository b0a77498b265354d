"""WARC writing and reading with segmented records and chunked transfer framing.

Writing: each page becomes a `response` record whose block is an HTTP message with a chunked body, or a
`revisit` of the page with the smallest id among those with an equal payload. A block above `segment_bytes` is split:
the first segment keeps the record's type, the others are `continuation` records with the origin's id, their number
and, on the last one, the total length. Every record is a gzip member of its own. Files roll at `file_bytes`.

Reading: records stream from the files; segments are grouped by their origin id, ordered by number, and checked
for gaps and against the total length; then the chunked framing is decoded and the payload digest verified.

A record id is made of the page id, the payload digest, the task and the record's place in it, so each record has its own, also
where rows repeat. A revisit names the page that it refers to by its id, in a field of our own, so it needs no record id that
another task made. Reading takes one pass over the files; the segments wait in the shared folder.

Cases: a null html is the empty payload. Repeated rows with the smallest id of their payload are all responses; with a
null page_id they revisit the smallest id, if there is one. A null url is written as urn:none. Equal rows that are split give
as many records. An empty table gives no file and no row. Payloads above 2 GB do not fit a Spark value. Only page_id, url and
html are read, whatever the other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.llm.shared import filesystem, one_task_a_file, shared_folder

MANIFEST_SCHEMA = "path string, n_records long, n_bytes long"
SEGMENT_SCHEMA = "record_id string, digest string, segment int, total long, block binary"
PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP_BYTES = 16 << 10
URN = re.compile(r"<urn:page:(-?\d+|null):")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None, digest: str, place: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}:{place}>"


def page_of(urn: str | None) -> int | None:
    m = URN.match(urn or "")
    return None if m is None or m[1] == "null" else int(m[1])


def chunked(payload: bytes, chunk: int = 8192) -> bytes:
    parts = []
    for at in range(0, len(payload), chunk):
        piece = payload[at : at + chunk]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def record(kind: str, urn: str, block: bytes, **fields: object) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": urn, "WARC-Date": DATE, **{k.replace("_", "-"): v for k, v in fields.items() if v is not None}, "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", "", url or "") or "urn:none"


def page_records(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None, revisit: bool, place: str, segment_bytes: int) -> Iterator[bytes]:
    urn, uri = record_urn(page_id, digest, place), clean(url)
    fields = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}", "Content_Type": "application/http; msgtype=response"}
    if revisit:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
        yield record("revisit", urn, head, Refers_To_Page=refers_to, WARC_Profile=PROFILE, **fields)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload or b"")
    if len(block) <= segment_bytes:
        yield record("response", urn, block, **fields)
        return
    cuts = range(0, len(block), segment_bytes)
    yield record("response", urn, block[:segment_bytes], WARC_Segment_Number=1, **fields)
    for k, at in enumerate(cuts[1:], 2):
        last = len(block) if k == len(cuts) else None
        yield record("continuation", f"{urn[:-1]}:segment{k}>", block[at : at + segment_bytes], WARC_Target_URI=uri, WARC_Segment_Number=k, WARC_Segment_Origin_ID=urn, WARC_Segment_Total_Length=last)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null for revisits), n_bytes, sha1, refers_to, revisit."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1("html"))
    # only payloads that occur more than once need a partner, so the joined side stays small
    firsts = rows.where(F.col("n_bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha1", "first")
    joined = rows.join(firsts, "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (F.col("n_bytes") >= least_bytes)
    return joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "n_bytes", "sha1", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(marked: DataFrame, folder: str, segment_bytes: int = 32 << 10, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes .warc.gz files of the marked rows; returns the manifest rows of the files that count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        part, row = TaskContext.get().partitionId(), 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            for page_id, url, html, n_bytes, sha1, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest, row = base64.b32encode(bytes.fromhex(sha1)).decode(), row + 1
                for raw in page_records(page_id, url, None if html is None else html.encode(), n_bytes, digest, refers_to, revisit, f"{part}.{row}", segment_bytes):
                    if out is None:
                        name, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    packed = packer.compress(raw) + packer.flush()
                    out.write(packed)
                    n, size = n + 1, size + len(packed)
                    if size >= file_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    return marked.mapInArrow(write, MANIFEST_SCHEMA)


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a stream of gzip members."""
    unpacker, held = zlib.decompressobj(31), bytearray()
    while raw := memoryview(stream.read(1 << 20)):
        # in small steps, as what follows the end of a member is copied
        for at in range(0, len(raw), STEP_BYTES):
            pending = raw[at : at + STEP_BYTES]
            while pending:
                held += unpacker.decompress(pending)
                pending = unpacker.unused_data
                if unpacker.eof:
                    unpacker = zlib.decompressobj(31)
                    yield parse_record(bytes(held))
                    held = bytearray()
    if held:
        raise ValueError("the file ends within a record")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    end = raw.index(b"\r\n\r\n")
    version, *lines = raw[:end].decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(fields["content-length"])
    if raw[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("a block does not end where its length says")
    return fields, raw[end + 4 : end + 4 + n]


def decode_http(block: bytes) -> tuple[dict[str, str], bytes]:
    end = block.index(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in block[:end].decode().split("\r\n")[1:])}
    body = block[end + 4 :]
    return fields, unchunk(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def page_row(urn: str, kind: str, refers_to: str | None, digest: str, block: bytes) -> tuple:
    fields, payload = decode_http(block)
    digest = digest.removeprefix("sha1:")
    if kind == "revisit":
        return page_of(urn), int(fields["content-length"]), digest, kind, int(refers_to), None
    if sha1_base32(payload) != digest:
        raise ValueError(f"the payload of {urn} does not have its digest")
    return page_of(urn), len(payload), digest, kind, None, payload


def read_files(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Of the files in the manifest, in one pass: whole records as PAGE_SCHEMA, and segments as SEGMENT_SCHEMA, with nulls in the
    columns of the other."""
    schema = f"{PAGE_SCHEMA}, {SEGMENT_SCHEMA}"
    n_page, n_segment = len(PAGE_SCHEMA.split(", ")), len(SEGMENT_SCHEMA.split(", "))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            system, name = filesystem(path)
            rows, size = [], 0
            with system.open_input_stream(name, compression=None) as stream:
                for fields, block in records_in(stream):
                    urn, part = fields["warc-record-id"], fields.get("warc-segment-number")
                    if part is not None:
                        total = fields.get("warc-segment-total-length")
                        rows.append((*[None] * n_page, fields.get("warc-segment-origin-id", urn), fields.get("warc-payload-digest"), int(part), int(total) if total else None, block))
                    else:
                        row = page_row(urn, fields["warc-type"], fields.get("refers-to-page"), fields["warc-payload-digest"], block)
                        rows.append((*(row if with_payload else (*row[:5], None)), *[None] * n_segment))
                    size += len(block)
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield rows_batch(rows, schema)
                        rows, size = [], 0
            if rows:
                yield rows_batch(rows, schema)

    return one_task_a_file(manifest.select("path")).mapInArrow(read, schema)


def rows_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def join_segments(parts: list[tuple[int, int | None, bytes]]) -> list[bytes]:
    """The blocks of one origin's (number, total, block) segments; as many blocks as there are copies of each, as other
    writers may have given equal records one id."""
    parts = sorted(parts, key=lambda p: (p[0], p[2]))
    numbers = sorted({p[0] for p in parts})
    copies, rest = divmod(len(parts), len(numbers))
    totals = {p[1] for p in parts if p[1] is not None}
    if rest or numbers != list(range(1, len(numbers) + 1)) or len(totals) != 1:
        raise ValueError("segments are missing")
    block = b"".join(parts[k * copies][2] for k in range(len(numbers)))
    if len(block) != totals.pop():
        raise ValueError("the segments do not add up to the total length")
    return [block] * copies


def reassemble(segments: DataFrame, with_payload: bool = True) -> DataFrame:
    """PAGE_SCHEMA rows of segmented records: grouped by origin id, ordered, checked and decoded. A group is one record, whose
    payload is one Spark value, so it is bounded by that."""
    groups = segments.groupBy("record_id").agg(F.max("digest").alias("digest"), F.collect_list(F.struct("segment", "total", "block")).alias("parts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(len(whole)):
                urn, digest, parts = (c[i].as_py() for c in whole.columns)
                rows = [page_row(urn, "response", None, digest, b) for b in join_segments([(p["segment"], p["total"], p["block"]) for p in parts])]
                yield rows_batch(rows if with_payload else [(*r[:5], None) for r in rows], PAGE_SCHEMA)

    return groups.mapInArrow(decode, PAGE_SCHEMA)


def read_warc(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """PAGE_SCHEMA rows of all records in the files of the manifest."""
    folder = shared_folder(spark, "warc-read")
    read_files(manifest, with_payload).write.parquet(folder)
    rows = spark.read.schema(f"{PAGE_SCHEMA}, {SEGMENT_SCHEMA}").parquet(folder)
    whole = rows.where("record_id is null").select(*(c.split()[0] for c in PAGE_SCHEMA.split(", ")))
    return whole.unionByName(reassemble(rows.where("record_id is not null").select("record_id", "digest", "segment", "total", "block"), with_payload))


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, least_bytes: int = 0, **options) -> DataFrame:
    """Writes the archives and a table of their names; returns that manifest."""
    folder = folder or shared_folder(spark, "warc")
    write_warc(mark_revisits(pages, least_bytes), f"{folder}/files", **options).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def page_digests(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The contract's rows, read back from the archives."""
    return read_warc(spark, archive_pages(spark, pages), with_payload=False).drop("payload")
