"""Quality classifier: random-indexing word vectors, pooled per document, in a two-layer network with temperature.

Random indexing: every sign (a word, a word's shape, a repetition mark) has a sparse random index vector drawn from a
hash of the sign. A word's vector is the sum of the index vectors of its neighbours, up to two places away, over the training texts,
scaled to unit length. A document's features are two pools over its whole text: the mean of its words'
vectors, and the mean of the index vectors of its signs of form (shapes such as `Aa,` or `a*`; marks for words that
repeat an earlier one nearby; marks for the share of distinct words in each stretch of 64 and in the rest after them).

The network (tanh, then logistic) is trained in numpy on four fifths of the training rows; the others set the
temperature by which its logits are divided, so that scores are calibrated probabilities.

The fit takes at most `fit_rows` labelled rows of the training folds, those with the smallest hash of
doc_id, whole texts each, and word vectors for at most `MOST_WORDS` words of them, the commonest. It runs in one task; all other
work is map-only over all rows.

Cases: an empty or null text has zero pools and gets the score that these lead to. Labels that are null or whose document
is missing are not learnt from; of repeated labels all count, of rows with one doc_id the one with the smallest text. With no label of one class the score is the
smoothed share of label 1. A null doc_id hashes as the empty text. Further columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.llm.shared import hash_fold, placed, texts_of

WORD_DIMS, FORM_DIMS, NONZERO, HIDDEN = 48, 96, 4, 24
FIT_ROWS = 6000
MOST_WORDS = 20_000
MEMO, MEMO_CHARS = 200_000, 64
THRESHOLD = 0.3
STRETCH = 64
RUN = re.compile(r"(.)\1+", re.DOTALL)
SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def index_vector(sign: str, dims: int) -> np.ndarray:
    """Sparse random vector of the sign: NONZERO places of 1 or -1, by its hash."""
    import xxhash

    rng = np.random.default_rng(xxhash.xxh64_intdigest(sign.encode("utf-8", "surrogatepass"), 7))
    out = np.zeros(dims, np.float32)
    out[rng.choice(dims, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def shape(word: str) -> str:
    """Of the whole word: letters as A or a, digits as 0, other signs as they are, runs of one kind as one; long words end in a
    plus."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return RUN.sub(r"\1", kinds) + ("+" if len(word) > 16 else "")


class Features:
    """Turns texts into pooled vectors, given the word vectors."""

    def __init__(self, words: dict[str, int], vectors: np.ndarray):
        self.words, self.vectors = words, np.concatenate([np.zeros((1, WORD_DIMS), np.float32), vectors])
        self.shapes: dict[str, int] = {}  # word -> row of forms
        self.rows: dict[str, int] = {}  # sign of form -> row of forms
        self.forms = np.zeros((256, FORM_DIMS), np.float32)
        self.repeats = [self.form(f"=prev{k}") for k in range(1, 9)]
        self.distinct = [self.form(f"distinct{k}") for k in range(11)]

    def form(self, sign: str) -> int:
        row = self.rows.get(sign)
        if row is None:
            row = self.rows[sign] = len(self.rows)
            if row == len(self.forms):
                self.forms = np.concatenate([self.forms, np.zeros_like(self.forms)])
            self.forms[row] = index_vector(sign, FORM_DIMS)
        return row

    def of_word(self, word: str) -> int:
        if len(self.shapes) > MEMO:
            self.shapes.clear()
        row = self.form("shape:" + shape(word))
        if len(word) <= MEMO_CHARS:
            self.shapes[word] = row
        return row

    def pool(self, text: str) -> np.ndarray:
        tokens = text.split()
        out = np.zeros(WORD_DIMS + FORM_DIMS, np.float32)
        if not (n := len(tokens)):
            return out
        if len(self.rows) > MEMO:
            self.__init__(self.words, self.vectors[1:])
        ids = np.fromiter(map(self.words.get, map(str.lower, tokens), repeat(0)), np.int64, n)
        for at in range(0, n, 1 << 16):
            out[:WORD_DIMS] += self.vectors[ids[at : at + (1 << 16)]].sum(0)
        try:
            forms = np.fromiter(map(self.shapes.__getitem__, tokens), np.int64, n)
        except KeyError:
            get = self.shapes.get
            forms = np.fromiter((self.of_word(w) if (row := get(w)) is None else row for w in tokens), np.int64, n)
        counts = np.bincount(forms, minlength=len(self.rows)).astype(np.float32)
        hashes = np.fromiter(map(hash, tokens), np.int64, n)
        for k, row in enumerate(self.repeats, 1):
            counts[row] += np.count_nonzero(hashes[k:] == hashes[:-k])
        whole = n // STRETCH * STRETCH
        for blocks in (hashes[:whole].reshape(-1, STRETCH), hashes[None, whole:]):
            if blocks.size:
                blocks = np.sort(blocks, axis=1)
                share = ((np.diff(blocks, axis=1) != 0).sum(1) + 1) * 10 // blocks.shape[1]
                counts[self.distinct] += np.bincount(share, minlength=11) * blocks.shape[1]
        used = np.flatnonzero(counts)
        out[WORD_DIMS:] = counts[used] @ self.forms[used]
        return out / n


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The commonest words of the texts (of two occurrences at least) and their random-indexing vectors."""
    counts: Counter = Counter()
    for t in texts:
        counts.update(t.lower().split())
    kept = sorted((w for w, c in counts.items() if c > 1), key=lambda w: (-counts[w], w))[:MOST_WORDS]
    words = {w: i for i, w in enumerate(kept, 1)}
    index = np.stack([np.zeros(WORD_DIMS, np.float32), *(index_vector("word:" + w, WORD_DIMS) for w in kept)])
    sums = np.zeros_like(index)
    for t in texts:
        ids = np.fromiter(map(words.get, t.lower().split(), repeat(0)), np.int64)
        if len(ids) < 2:
            continue
        around = np.zeros((len(ids), WORD_DIMS), np.float32)
        for k in (1, 2):
            around[k:] += index[ids[:-k]]
            around[:-k] += index[ids[k:]]
        order = np.argsort(ids, kind="stable")
        cuts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        sums[ids[order][cuts]] += np.add.reduceat(around[order], cuts, axis=0)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return words, (sums / np.maximum(norms, 1e-9))[1:]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Two layers, on standardized features; `temperature` divides the logit."""

    def __init__(self, dims: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(dims), np.ones(dims), 1.0
        self.w = [rng.normal(0, dims**-0.5, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> None:
        self.mean = x.mean(0)
        self.scale = x.std(0) + 0.02 * (x.std() + 1e-9)
        z, t = ((x - self.mean) / self.scale)[~held], y[~held]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, steps + 1):
            a, b, c, d = self.w
            h = np.tanh(z @ a + b)
            e = (sigmoid(h @ c + d[0]) - t) / len(t)
            g = (e[:, None] * c) * (1 - h * h)
            grads = [z.T @ g + decay * a, g.sum(0), h.T @ e + decay * c, np.array([e.sum()])]
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if held.any():
            logits, t = self.logit(x[held]), y[held]
            loss = lambda s: -np.mean(np.log(np.where(t == 1, sigmoid(logits / s), sigmoid(-logits / s)) + 1e-12))
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))


class Model:
    """Everything that a score needs; pickles to a few MB at most."""

    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array(labels, np.float64)
        self.share = float((y.sum() + 1) / (len(y) + 2))
        self.words, self.vectors, self.network = {}, np.zeros((0, WORD_DIMS), np.float32), None
        if len(set(labels)) < 2:
            return
        self.words, self.vectors = word_vectors(texts)
        features = Features(self.words, self.vectors)
        x = np.stack([features.pool(t) for t in texts]).astype(np.float64)
        held = np.arange(len(y)) % 5 == 4
        if len(set(y[~held])) < 2:
            held[:] = False
        self.network = Network(x.shape[1])
        self.network.fit(x, y, held)

    def scores(self, texts: list[str], features: Features) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.score(np.stack([features.pool(t) for t in texts]).astype(np.float64)) if texts else np.empty(0)


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, held_out_fold: int | None = 0) -> bytes:
    """The pickled model, from at most fit_rows labelled rows outside the held-out fold."""
    chosen = labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) quality").where("doc_id is not null and quality in (0, 1)")
    if held_out_fold is not None:
        chosen = chosen.where(hash_fold("doc_id") != held_out_fold)
    # a bounded number of (id, label) pairs: small enough to be sent to every task
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    ids = F.broadcast(chosen.select("doc_id").distinct())
    # one row per doc_id, so that a repeated id brings no more rows than there are labels
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(ids, "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "doc_id")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True)]
        rows.sort(key=lambda r: (hash_of(r[0]), r[1], r[2]))  # the same order whatever the partitions were
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())], names=["model"])

    row = texts.select("doc_id", "text", "quality").repartition(1).mapInArrow(fit, "model binary").first()
    return row.model if row else pickle.dumps(Model([], []))


def hash_of(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def scored(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model)
        features = Features(own.words, own.vectors)
        for batch in batches:
            scores = own.scores(texts_of(batch.column(1)), features)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double")


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    out = scored(docs, fit_model(docs, labels, fit_rows))
    return out.select("doc_id", (hash_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs, all columns, without the rows that score under the threshold.

    Null and empty texts are scored as empty, equal rows alike; a row without doc_id is scored, but not learnt from.
    """
    rows, (doc_id, text) = placed(docs, "doc_id", "text")
    model, place = fit_model(rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, fit_rows), rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model)
        features = Features(own.words, own.vectors)
        for batch in batches:
            yield batch.filter(pa.array(own.scores(texts_of(batch.column(place)), features) >= THRESHOLD))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
