"""Secret scanning through a ledger of content-addressed blobs.

Every version of a text is a blob, named by the SHA-256 of its UTF-8 bytes. The ledger holds one row per
(blob, rule version) that has been scanned, with its findings. A run hashes all rows, keeps the blobs that the ledger
lacks for the present rule version, scans each of these once, appends them, and joins the findings
back to every row that holds the blob. Running again over old and new versions scans only the new ones; a
changed rule set has another version and scans everything anew.

Rules: `assign`, `access` and `hex` as the base, then rules of our own (whole private key blocks, web
tokens, service tokens, credentials within URLs). Within a kind, matches are leftmost and do not overlap;
matches that fail a kind's length test are dropped after matching, so they still use up their text.
Offsets count code points, ends are exclusive.

Cases: a null text is the empty text. Rows with equal texts share one scan, with repeated doc_ids kept as rows. An empty table gives an
empty result. Columns other than doc_id and text are not read. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.llm.shared import placed, shared_folder, texts_of

# kind -> (pattern, group whose length counts, least length); the base kinds are fixed values of the contract
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = {
    "assign": (re.compile(ASSIGN, re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]{12,}"), 0, 16),  # a run of under 16 fails as a whole
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
# A key block goes to its END line, but not past another BEGIN; without one, on through the base64 that follows. Line ends may be escaped.
KEY_NAME, EOL, BASE64 = r"[A-Z ]{0,40}PRIVATE KEY-----", r"(?:\r?\n|\r|(?:\\r)?\\n)", r"[A-Za-z0-9+/=]"
TO_END = rf"(?:(?!-----BEGIN )[\s\S])*?-----END {KEY_NAME}"
NO_END = rf"(?:{EOL}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:(?:{EOL}|[\x20\t>])*{BASE64}{{16,}})*(?:{EOL}{BASE64}{{1,15}}(?={EOL}|\Z))*"
ADDED_RULES = {
    "private_key": (re.compile(rf"-----BEGIN {KEY_NAME}(?:{TO_END}|{NO_END})"), 0, 0),
    # from the first `eyJ` of a run of its signs, which is passed once: a longer text takes longer in proportion
    "web_token": (re.compile(r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(?P<span>eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"), 0, 0),
    "service_token": (re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"), 0, 0),
    "url_login": (re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/@]{3,}@"), 0, 0),
}
RULES = BASE_RULES | ADDED_RULES
RULE_VERSION = hashlib.sha256("\n".join(f"{k} {r.pattern} {r.flags} {g} {n}" for k, (r, g, n) in RULES.items()).encode()).hexdigest()[:16]
#: A cheap test that each kind's matches pass.
HINTS = {"access": "AKIA", "private_key": "PRIVATE KEY-----", "web_token": "eyJ", "url_login": "://"}
LEDGER_SCHEMA = "blob string, rule_version string, kinds array<string>, starts array<int>, ends array<int>"
BLOB_SCHEMA = "blob string, text string"


def find_spans(text: str, rules: dict = RULES) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, by start and then by the order of the kinds."""
    found = []
    for order, (kind, (pattern, group, least)) in enumerate(rules.items()):
        if kind in HINTS and HINTS[kind] not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start("span") if "span" in pattern.groupindex else m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def blob_id(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, text) with a blob's text once per run of recent blobs in the task, so that hot blobs shrink before the shuffle."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, text in enumerate(texts_of(batch.column(0))):
            key = hashlib.sha256(text.encode()).digest()
            if key not in seen:
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                keep.append((key.hex(), text))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.string()), pa.array([t for _, t in keep], pa.string())], names=["blob", "text"])


def scan_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ledger rows of (blob, text) rows that are sorted by blob within the partition; equal blobs are scanned once."""
    last = None
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if blob == last:
                continue
            last = blob
            spans = find_spans(text)
            for column, value in zip(columns, (blob, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans]), strict=True):
                column.append(value)
        blobs, kinds, starts, ends = columns
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array([RULE_VERSION] * len(blobs), pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, ints), pa.array(ends, ints)], names=["blob", "rule_version", "kinds", "starts", "ends"])


class BlobLedger:
    """The table of scanned blobs in a folder that all executors share; each run appends a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark, "blob-ledger")

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return bool(system.exists(path)) and any(s.getPath().getName().endswith(".parquet") for s in system.listStatus(path))

    def read(self, version: str = RULE_VERSION) -> DataFrame:
        """One row per blob, also where two runs scanned it at the same time. Keyed by both columns, so that a join by blob
        deals the rows anew and can split a hot one."""
        rows = self.spark.read.schema(LEDGER_SCHEMA).parquet(self.folder) if self.exists() else self.spark.createDataFrame([], LEDGER_SCHEMA)
        return rows.where(F.col("rule_version") == version).dropDuplicates(["blob", "rule_version"])

    def scan(self, texts: DataFrame) -> None:
        """Scans those blobs of texts(text) which the ledger lacks for this rule version, and appends them."""
        blobs = texts.select(F.col("text").cast("string")).mapInArrow(first_in_task, BLOB_SCHEMA)
        blobs = blobs.repartition(F.col("blob"))
        if self.exists():  # both sides are dealt by blob, so the texts are shuffled once
            blobs = blobs.join(self.read().select("blob"), "blob", "left_anti").select("blob", "text")
        blobs.sortWithinPartitions("blob").mapInArrow(scan_sorted, LEDGER_SCHEMA).write.mode("append").parquet(self.folder)

    def findings(self, paths: DataFrame) -> DataFrame:
        """The rows of paths(…, text) with blob, kinds, starts and ends; the text itself is dropped."""
        return paths.withColumn("blob", blob_id()).drop("text").join(self.read().drop("rule_version"), "blob", "left")


def scan_documents(spark: SparkSession, docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, blob, kinds, starts, ends) for every row of docs(doc_id, text)."""
    ledger = BlobLedger(spark, folder)
    ledger.scan(docs)
    return ledger.findings(docs.select("doc_id", "text"))


def span_digests(found: DataFrame) -> DataFrame:
    """The contract's rows from scan_documents."""
    spans = F.arrays_zip("kinds", "starts", "ends")
    as_text = lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))
    base = F.filter(spans, lambda x: x["kinds"].isin(*BASE_RULES))
    n = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return found.select(
        "doc_id",
        *(n(kind).alias(f"n_{kind}") for kind in BASE_RULES),
        F.sha2(F.array_join(F.transform(base, as_text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, as_text), ",").alias("spans"),
    )


def redact(spark: SparkSession, docs: DataFrame, mark: str = "[secret]", folder: str | None = None) -> DataFrame:
    """docs with every span of its text replaced by the mark, and n_chars, if there, counted anew.

    Only the texts with findings change; all rows and columns stay, whatever the columns are called. The scan is by blob, as
    above; the marks are set while rows stream by, from the findings joined on the blob. A null text stays null.
    """
    ledger = BlobLedger(spark, folder)
    rows, (text, *counted) = placed(docs, "text", *(c for c in docs.columns if c == "n_chars"))
    ledger.scan(rows.select(F.col(text).alias("text")))
    hits = ledger.read().where(F.size("kinds") > 0).select("blob", "starts", "ends")
    joined = rows.withColumn("blob", blob_id(text)).join(hits, "blob", "left")
    # spans may overlap across kinds: they are merged, and the pieces between them are kept
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    state = F.named_struct(F.lit("out"), F.lit(""), F.lit("at"), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["starts"] >= acc["at"]
        kept = F.when(fresh, F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, x["starts"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.named_struct(F.lit("out"), kept, F.lit("at"), F.greatest(acc["at"], x["ends"]))

    done = F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    found = F.col("starts").isNotNull()
    out = joined.withColumn("new", F.when(found, done).otherwise(F.col(text)))
    kind = dict(rows.dtypes)
    columns = [F.col("new") if c == text else F.when(found, F.length("new").cast(kind[c])).otherwise(F.col(c)) if c in counted else F.col(c) for c in rows.columns]
    return out.select(*(c.alias(name) for c, name in zip(columns, rows.columns, strict=True))).toDF(*docs.columns)
