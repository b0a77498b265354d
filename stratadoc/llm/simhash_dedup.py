"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: words of the text in ASCII lower case, 3-word shingles, XXH64 with seed 42; a bit is set if it
is set in over half of the shingles' hashes. Distinct fingerprints that differ in at most 3 bits are linked, and
a component's id is the smallest doc_id in it.

The search is dealt over tasks by 16-bit blocks: of four blocks, at least one is equal in a linked pair. A block
value that holds more than `hot_bucket` fingerprints is refined: the other 48 bits form four sub-blocks, of which
again at least one is equal, so no link is lost; and so on with the bits that are left, until 15 are, of which there are
32768 values. So no bucket grows with a hot value. (From the second step on, a bucket is hot beyond 1/65536 of the rows, too,
which bounds the list of hot ones.) Within a bucket, fingerprints are sorted by their Gray rank, so
neighbours share most bits. Runs of them are leaves; a leaf's node keeps the bits that all its members share as a mask and a
pattern, and upper nodes factor out what their children share. A pair of nodes is dropped with everything below
it when the differences accumulated in bits that both have fixed exceed 3.

A bucket gives no pairs but a forest: each fingerprint with the smallest one that it is connected to there. A
dense group of m near copies thus gives under m links per bucket, and pairs of leaves that are already in one
component are not compared. Components over all buckets come from alternating large-star and small-star steps
on written tables.

Cases: a text without words has fingerprint zero and is linked like any other. Null texts count as empty.
Rows with equal doc_ids stay rows. Null doc_ids never name a component; one of only such rows has a
null id. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratadoc.llm.shared import shared_folder

SEED = 42
LEAF, FAN = 32, 8
HOT_BUCKET = 4096


def shingle_hashes(text: str, width: int = 3) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint: bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((majority_bits(shingle_hashes(t or "")) for t in batch.column(1).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long")


def with_fingerprints(rows: DataFrame, text: str) -> DataFrame:
    """rows, all columns, and fp of the text column."""
    place, names = rows.columns.index(text), [*rows.columns, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((majority_bits(shingle_hashes(t or "")) for t in batch.column(place).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fp", LongType())]))


# --- the index within a bucket -------------------------------------------------------------------------


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in Gray-code order."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Union-find whose roots are the smallest member, in whole-array steps."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        return r

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def flatten(self) -> np.ndarray:
        self.parent = self.roots(np.arange(len(self.parent)))
        return self.parent


class GrayIndex:
    """A hierarchy over distinct fingerprints in Gray order; levels[0] are the leaves."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        every, some = self.fps, self.fps
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        width = LEAF
        while not self.levels or len(self.levels[-1][0]) > 1:
            cuts = np.arange(0, len(every), width)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            self.levels.append((~(every ^ some), every))  # bits that all below share, and their values
            width = FAN

    def near(self, level: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        mask, pattern = self.levels[level]
        return np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= most

    def components(self, most: int = 3) -> np.ndarray:
        """For each fingerprint, the place (in the input) of its component's first member in Gray order."""
        n, forest = len(self.fps), Forest(len(self.fps))
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if level < 0:
                self._leaves(forest, a, b, most)
                continue
            keep = self.near(level, a, b, most)
            a, b = a[keep], b[keep]
            if level == 0:
                for at in range(0, len(a), 512):
                    stack.append((-1, a[at : at + 512], b[at : at + 512]))
                continue
            below = len(self.levels[level - 1][0])
            for at in range(0, len(a), 4096):
                x = (a[at : at + 4096, None, None] * FAN + np.arange(FAN)[:, None] + np.zeros(FAN, np.int64)).ravel()
                y = (b[at : at + 4096, None, None] * FAN + np.zeros((FAN, 1), np.int64) + np.arange(FAN)).ravel()
                keep = (x <= y) & (x < below) & (y < below)
                stack.append((level - 1, x[keep], y[keep]))
        roots = np.empty(n, np.int64)
        roots[self.order] = self.order[forest.flatten()]
        return roots

    def _leaves(self, forest: Forest, a: np.ndarray, b: np.ndarray, most: int) -> None:
        n = len(self.fps)
        flat = forest.flatten()
        cuts = np.arange(0, n, LEAF)
        low, high = np.minimum.reduceat(flat, cuts), np.maximum.reduceat(flat, cuts)
        open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[open_], b[open_]
        for at in range(0, len(a), 256):
            i = (a[at : at + 256, None] * LEAF + np.arange(LEAF))[:, :, None]
            j = (b[at : at + 256, None] * LEAF + np.arange(LEAF))[:, None, :]
            x, y = self.fps[np.minimum(i, n - 1)], self.fps[np.minimum(j, n - 1)]
            hit = (np.bitwise_count(x ^ y) <= most) & (i < j) & (j < n)
            k, p, q = np.nonzero(hit)
            forest.union(i[k, p, 0], j[k, 0, q])


def bucket_forest(fps: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, an earlier one in the same component) of one bucket's distinct fingerprints."""
    roots = GrayIndex(fps).components(most)
    moved = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[moved], fps[roots[moved]]


def small_buckets(fps: np.ndarray, starts: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of many buckets of one small size (a leaf each), compared at once."""
    i, j = np.triu_indices(size, 1)
    found = [], []
    for at in range(0, len(starts), max(1, (1 << 20) // len(i))):
        rows = fps[starts[at : at + max(1, (1 << 20) // len(i)), None] + np.arange(size)]
        k, p = np.nonzero(np.bitwise_count(rows[:, i] ^ rows[:, j]) <= most)
        found[0].append(rows[k, j[p]])
        found[1].append(rows[k, i[p]])
    return np.concatenate(found[0]), np.concatenate(found[1])


SMALL = 12


def link_buckets(batches: Iterator[pa.RecordBatch], most: int = 3) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of (bucket, fp) rows that are sorted by bucket within the partition."""
    held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)

    def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1]) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for size in range(2, SMALL + 1):
            if len(at := starts[sizes == size]):
                a, b = small_buckets(fps, at, size, most)
                out_a.append(a)
                out_b.append(b)
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            a, b = bucket_forest(fps[start : start + size], most)
            out_a.append(a)
            out_b.append(b)
        a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
        fps = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield solve(keys[:cut], fps[:cut])
        held_keys, held = keys[cut:], fps[cut:]
    yield solve(held_keys, held)


# --- buckets ------------------------------------------------------------------------------------------


#: Bits of the four blocks at each step of refinement; 15 bits are left after the last.
STEPS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6), (5, 5, 5, 5))
MOST_HOT = 1 << 16


def block_keys(fps: np.ndarray, hot: list[np.ndarray], only_last: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, fingerprint): a row for each block of each step, down to where its value is not hot.

    hot: for each step, the sorted hot buckets. A bucket's number holds the places and values of its equal blocks, and has
    another length at each step. only_last: just the rows of the step after the last of hot.
    """
    keys, out = [], []

    def deal(own: np.ndarray, rest: np.ndarray, prefix: np.ndarray, step: int) -> None:
        widths, at = STEPS[step], 0
        for j, width in enumerate(widths):
            value = (rest >> np.uint64(at)) & np.uint64((1 << width) - 1)
            key = (prefix << (2 + widths[0])) | (j << widths[0]) | value.astype(np.int64)
            is_hot = np.isin(key, hot[step]) if step < len(hot) and len(hot[step]) else np.zeros(len(key), bool)
            if step == len(hot) or not only_last:
                keys.append(key[~is_hot])
                out.append(own[~is_hot])
            if is_hot.any():
                # the other bits move together
                left = rest[is_hot]
                left = (left & np.uint64((1 << at) - 1)) | ((left >> np.uint64(at + width)) << np.uint64(at) if at + width < 64 else np.uint64(0))
                deal(own[is_hot], left, key[is_hot], step + 1)
            at += width

    deal(fps, fps, np.ones(len(fps), np.int64), 0)
    return np.concatenate(keys), np.concatenate(out)


def link_fingerprints(nodes: DataFrame, hot_bucket: int = HOT_BUCKET, most: int = 3) -> DataFrame:
    """Links (a, b) that connect every two fingerprints of nodes(fp), distinct, with at most `most` differing bits."""
    if most > 3:
        raise ValueError("four blocks find pairs of up to three differing bits")

    def dealt(hot: list[np.ndarray], only_last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, fps = block_keys(batch.column(0).to_numpy().view(np.uint64), hot, only_last)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64))], names=["bucket", "fp"])

        return nodes.select("fp").mapInArrow(run, "bucket long, fp long")

    blocks = F.array(*(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(1 << 18 | i << 16)) for i in range(4)))
    counted = nodes.select(F.explode(blocks).alias("bucket")).groupBy("bucket").count()
    hot: list[np.ndarray] = []
    while True:
        found = counted.where(F.col("count") > hot_bucket)
        if hot:
            # of so many rows, no more than MOST_HOT buckets can hold the share that makes one hot; at the first step there are 4 x 65536 values
            rows = counted.agg(F.sum("count")).first()[0] or 0
            found = found.where(F.col("count") > rows // MOST_HOT)
        values = np.sort(np.array([r.bucket for r in found.select("bucket").collect()], np.int64))
        if not len(values):
            break
        hot.append(values)
        if len(hot) == len(STEPS) - 1:
            break
        counted = dealt(hot, True).groupBy("bucket").count()
    return dealt(hot, False).repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(partial(link_buckets, most=most), "a long, b long")


# --- components ----------------------------------------------------------------------------------------


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b) that is not itself the smallest of its component."""
    folder = shared_folder(spark, "components")

    def written(edges: DataFrame, step: int) -> tuple[DataFrame, tuple]:
        edges.write.parquet(f"{folder}/{step}")
        edges = spark.read.parquet(f"{folder}/{step}")
        n, mix = edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return edges, (n, mix)

    edges, seen = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    step = 0
    while seen[0]:
        step += 1
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, now = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), step)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components_of(spark: SparkSession, prints: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(fp, root, component_id) for the distinct fingerprints of prints(doc_id, fp); root: the component's smallest fingerprint."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(spark, link_fingerprints(nodes, hot_bucket))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return nodes.join(ids, "root").select("fp", "root", "component_id")


def groups_of(spark: SparkSession, docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(fp, doc_id, root, component_id) for every row of docs(doc_id, text)."""
    folder = shared_folder(spark, "fingerprints")
    fingerprints(docs).write.parquet(folder)
    prints = spark.read.parquet(folder)
    return prints.join(components_of(spark, prints, hot_bucket), "fp", "left")


def near_duplicates(spark: SparkSession, docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs(doc_id, text)."""
    return groups_of(spark, docs, hot_bucket).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
