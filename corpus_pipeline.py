"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet in the folder that
all executors share and rereads it as the next stage's documents, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.llm.decontaminate import drop_leaked
from stratadoc.llm.packing import packed_pieces
from stratadoc.llm.quality import keep_good
from stratadoc.llm.secret_scan import redact
from stratadoc.llm.shared import make_importable, placed, shared_folder, table
from stratadoc.llm.simhash_dedup import groups_of, with_fingerprints


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; the classifier learns from all labelled documents of this input, up to its bound,
    outside the held-out fold. A null text is scored as the empty one; rows with equal texts fare alike; all columns stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one with the smallest doc_id.

    Rows without doc_id cannot be told apart by it and stay. Rows that share a doc_id are one document: of those that their
    group keeps, told apart from the others by their fingerprint, the one with the smallest text stays.
    Null and empty texts have fingerprint zero, so one of them stays. All columns stay, whatever they are called.
    """
    rows, (doc_id, text) = placed(docs, "doc_id", "text")
    texts = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    groups = groups_of(spark, texts).where("doc_id is not null")
    kept = groups.groupBy("root").agg(F.min("component_id").alias("doc_id"))
    # a doc_id that other rows have as well: few, so only their fingerprints are computed anew
    repeated = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    single = kept.join(repeated, "doc_id", "left_anti").select(F.col("doc_id").alias(doc_id))
    own = groups.join(repeated, "doc_id", "left_semi").where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("fp").alias("fp")).select("doc_id", "fp")
    again = rows.join(repeated.select(F.col("doc_id").alias(doc_id)), doc_id, "left_semi").select(*rows.columns)
    again = with_fingerprints(again, text).join(own.withColumnRenamed("doc_id", doc_id), [doc_id, "fp"], "left_semi")
    order = F.struct(F.col(text).isNotNull(), text, _row_hash(rows))
    again = again.groupBy(doc_id).agg(*(F.min_by(c, order).alias(c) for c in rows.columns if c != doc_id))
    out = rows.join(single, doc_id, "left_semi").select(*rows.columns).unionByName(again.select(*rows.columns))
    return out.unionByName(rows.where(F.col(doc_id).isNull())).toDF(*docs.columns)


def _row_hash(rows: DataFrame) -> Column:
    """One key for a whole row, so that all its columns are taken from the same one; a map has no hash but in its entries."""
    return F.xxhash64(*(F.map_entries(c) if kind.startswith("map<") else F.col(c) for c, kind in rows.dtypes if "map<" not in kind or kind.startswith("map<")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. A null or empty text holds none; rows with equal texts fare alike; all columns stay."""
    return drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark. A null text stays null; repeated rows stay; all columns stay, n_chars
    is counted anew where the text changes."""
    return redact(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences. A null or empty text is its end id; repeated rows are packed each."""
    return packed_pieces(docs)


STAGES = [("quality", quality), ("near_duplicates", one_of_each_group), ("decontamination", decontaminate), ("secrets", secrets), ("packing", packing)]

#: A trained classifier, fingerprints, edit distances and a tokenizer are beyond SQL: a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    make_importable(spark)
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
