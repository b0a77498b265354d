"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are reduced to words (letters and digits in lower case; in scripts without blanks, each sign is a word).
A document leaks an item if some stretch of its words is within edit distance 0.2 x the item's words (a similarity of 0.8) of the
whole item. Items under 5 words, for which that means no edit, are found where all their words stand in order.

1. Windows. A stretch within that distance shares a run of q words with the item at nearly the same offset (q = 3, or
   2 for items of 5 words: n - q + 1 - kq > 0 for k <= 0.2 n; all of them for shorter items). So windows of exactly the item's size are laid
   wherever the document has one of the item's runs, aligned by the run's offset. No leak lies elsewhere.
2. CGK. A window of n words walks along; at each step the word under the pointer is written out, and a random
   bit of (repetition, step, word) says whether the pointer moves. All of the method's 3n steps are walked. Strings at a
   small edit distance end in walks that agree at most steps, so edit distance becomes Hamming distance.
3. Bit sampling. `tables` x `repetitions` hash tables each compare `bits` sampled steps, drawn from those where few walks
   have ended (the first 2n), as steps after the end agree for nothing; a window that equals its item in any
   table is a candidate.
4. Verification. Candidates of a document and item are merged into stretches, and the exact least edit distance within them is
   found by bit-parallel dynamic programming.

Items are held in blocks of about `block_items`; documents are read once per block, and no table is joined. Windows are
looked at `WINDOWS` at a time, so a word that is frequent in items and documents takes time, but no memory.

Cases: items without words (null or empty) are not searched for. Null texts have no words. Items of several ids with equal
texts are all reported, equal rows of items once; rows with equal doc_ids are all reported. An empty table on either side gives no row. Only the columns
doc_id and text, item_id and text are read. Texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.llm.shared import placed, slices_by_bytes, texts_of

WORD = re.compile(r"[^\W_]+")
#: Han, kana, Thai, Lao, Myanmar and Khmer: scripts that put no blanks between words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ANY_WORD = re.compile(rf"(?![\W_])[{UNSPACED}]|[^\W_{UNSPACED}]+")
MOST_EDITS = 0.2
#: Texts of about so many characters are searched together.
SLICE_CHARS = 8 << 20
#: Windows that are walked and compared at a time, in parts of PART.
WINDOWS, PART = 1 << 19, 4096
GAP = 0  # the id of words that no item has
LEAK_SCHEMA = "doc_id long, item_id long, edits int, item_words int, end_word long"


def words_of(text: str) -> list[str]:
    return (WORD if text.isascii() else ANY_WORD).findall(text.lower())


def edits_allowed(n: int) -> int:
    return int(MOST_EDITS * n + 1e-9)


def run_length(n: int) -> int:
    return 3 if n >= 6 else 2 if n == 5 else n


def least_edits(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the pattern to any stretch of the text, where that stretch ends); bit-parallel."""
    n = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    every, top = (1 << n) - 1, 1 << (n - 1)
    up, down, edits = every, 0, n
    best, end = n, 0
    for j, w in enumerate(text, 1):
        match = masks.get(w, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up = down | ~(diagonal | up) & every
        right_down = up & diagonal
        if right_up & top:
            edits += 1
        elif right_down & top:
            edits -= 1
        # the first row stays zero: a stretch may begin anywhere
        right_up, right_down = right_up << 1 & every, right_down << 1 & every
        up = right_down | ~(diagonal | right_up) & every
        down = right_up & diagonal
        if edits < best:
            best, end = edits, j
    return best, end


class Walks:
    """CGK walks and sampled steps, the same for items and windows of a size."""

    def __init__(self, repetitions: int = 6, tables: int = 16, bits: int = 2, seed: int = 20):
        self.repetitions, self.tables, self.bits, self.seed = repetitions, tables, bits, seed

    def hashes(self, windows: np.ndarray) -> np.ndarray:
        """(windows, repetitions x tables) hash values of the sampled steps of each walk."""
        m, n = windows.shape
        rng = np.random.default_rng([self.seed, n])
        length, sampled = 3 * n, 2 * n
        odd = rng.integers(0, 1 << 64, (self.repetitions, length), np.uint64) | np.uint64(1)
        shift = rng.integers(0, 1 << 64, (self.repetitions, length), np.uint64)
        steps = np.stack([[rng.choice(sampled, min(self.bits, sampled), replace=False) for _ in range(self.tables)] for _ in range(self.repetitions)])
        factors = rng.integers(0, 1 << 63, (self.repetitions, self.tables, steps.shape[-1]), np.uint64) | np.uint64(1)
        out = np.zeros((m, self.repetitions * self.tables), np.uint64)
        ended = np.uint64((1 << 40) - 1)
        symbols = np.concatenate([windows.astype(np.uint64), np.full((m, 1), ended)], axis=1).ravel()
        row = np.arange(m) * (n + 1)
        for r in range(self.repetitions):
            at = np.zeros(m, np.int64)
            walk = np.empty((length, m), np.uint64)
            for j in range(length):
                s = symbols[row + at]
                walk[j] = s
                at += ((s * odd[r, j] + shift[r, j]) >> np.uint64(63)).astype(np.int64)
                np.minimum(at, n, out=at)
            for t in range(self.tables):
                value = np.zeros(m, np.uint64)
                for b in range(steps.shape[-1]):
                    value = (value ^ (walk[steps[r, t, b]] + np.uint64(1))) * factors[r, t, b]
                out[:, r * self.tables + t] = value
        return out


class LeakFinder:
    """The index of a block of items, and the search of texts against it."""

    def __init__(self, items: list[tuple[int, str]], walks: Walks | None = None):
        self.walks = walks or Walks()
        vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            w = words_of(text or "")
            if w:
                self.ids.append(item_id)
                self.items.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int64))
        self.vocabulary, self.base = vocabulary, len(vocabulary) + 1
        self.size = np.array([len(w) for w in self.items], np.int64)
        self.edits = np.array([edits_allowed(len(w)) for w in self.items], np.int64)
        self.postings = {q: self._postings(q) for q in (1, 2, 3, 4)}
        self.hashes: dict[int, dict[int, np.ndarray]] = {}
        for n in set(self.size.tolist()):
            members = np.flatnonzero(self.size == n)
            made = self.walks.hashes(np.stack([self.items[i] for i in members]))
            self.hashes[n] = dict(zip(members.tolist(), made, strict=True))

    def _postings(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct runs, first posting of each and the end, items, offsets) of the items with runs of q words."""
        runs, items, offsets = [], [], []
        for i, w in enumerate(self.items):
            if run_length(len(w)) == q:
                made = self._runs(w, q)
                runs.append(made)
                items.append(np.full(len(made), i))
                offsets.append(np.arange(len(made)))
        if not runs:
            return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        runs, items, offsets = np.concatenate(runs), np.concatenate(items), np.concatenate(offsets)
        order = np.argsort(runs, kind="stable")
        distinct, first = np.unique(runs[order], return_index=True)
        return distinct, np.append(first, len(runs)), items[order], offsets[order]

    def _runs(self, w: np.ndarray, q: int) -> np.ndarray:
        """A number for each run of q words; -1 where one of them is in no item."""
        if len(w) < q:
            return np.empty(0, np.int64)
        n = len(w) - q + 1
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(q):
            code = code * self.base + w[k : k + n]
            known &= w[k : k + n] != GAP
        return np.where(known, code, -1)

    def window_parts(self, w: np.ndarray, most: int = WINDOWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, start) of the windows to look at, about `most` at a time, each distinct there; a start may lie before or
        after its document."""
        longest = int(self.size.max(initial=0))
        span = len(w) + 2 * longest + 2
        for q, (distinct, first, post_items, post_offsets) in self.postings.items():
            runs = self._runs(w, q)
            if not len(distinct) or not len(runs):
                continue
            place = np.minimum(np.searchsorted(distinct, runs), len(distinct) - 1)
            at = np.flatnonzero(distinct[place] == runs)
            begin, counts = first[place[at]], (first[1:] - first[:-1])[place[at]]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            for low in range(0, total, most):
                number = np.arange(low, min(low + most, total))
                run = np.searchsorted(ends, number, side="right")
                entries = begin[run] + number - (ends[run] - counts[run])
                codes = np.unique(post_items[entries] * span + at[run] - post_offsets[entries] + longest)
                yield codes // span, codes % span - longest

    def windows(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All of them, each once."""
        parts = [np.empty((0, 2), np.int64), *(np.stack(p, 1) for p in self.window_parts(w))]
        items, starts = np.unique(np.concatenate(parts), axis=0).T
        return items, starts

    def candidates(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those windows whose walk meets the item's in some hash table."""
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for items, starts in self.window_parts(w):
            keep = np.zeros(len(items), bool)
            for n in np.unique(self.size[items]):
                of_size = np.flatnonzero(self.size[items] == n)
                for at in range(0, len(of_size), PART):
                    part = of_size[at : at + PART]
                    places = starts[part, None] + np.arange(n)
                    inside = (places >= 0) & (places < len(w))
                    made = self.walks.hashes(np.where(inside, w[np.clip(places, 0, len(w) - 1)], GAP))
                    want = np.stack([self.hashes[int(n)][i] for i in items[part].tolist()])
                    keep[part] = (made == want).any(axis=1)
            kept.append((items[keep], starts[keep]))
        items, starts = (np.concatenate(c) for c in zip(*kept, strict=True))
        return items, starts

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text's place, item_id, least edits, item's words, the word where the stretch ends) of every leak."""
        if not self.items:
            return
        get = self.vocabulary.get
        # texts are laid end to end with gaps that no window's run can cross
        lists = [[get(x, GAP) for x in words_of(t)] for t in texts]
        gap = int((self.size + self.edits).max()) + 1
        sizes = np.array([len(x) for x in lists], np.int64)
        begins = np.cumsum(sizes + gap) - sizes
        w = np.zeros(int((sizes + gap).sum()) + gap, np.int64)
        for begin, x in zip(begins, lists, strict=True):
            w[begin : begin + len(x)] = x
        items, starts = self.candidates(w)
        if not len(items):
            return
        middle = np.clip(starts + self.size[items] // 2, 0, len(w) - 1)
        text_of = np.searchsorted(begins - gap // 2, middle, side="right") - 1
        order = np.lexsort((starts, items, text_of))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        stretch: tuple | None = None

        def verify(s: tuple) -> None:
            doc, item, a, b = s
            a, b = max(a, begins[doc]), min(b, begins[doc] + sizes[doc])
            edits, end = least_edits(self.items[item].tolist(), w[a:b].tolist())
            found = (edits, int(a - begins[doc]) + end)
            if edits <= self.edits[item] and found < best.get((doc, item), (1 << 60, 0)):
                best[doc, item] = found

        for k in order.tolist():
            doc, item = int(text_of[k]), int(items[k])
            slack = int(self.edits[item])
            a, b = int(starts[k]) - slack, int(starts[k]) + int(self.size[item]) + slack
            if stretch and stretch[:2] == (doc, item) and a <= stretch[3]:
                stretch = (doc, item, stretch[2], b)
                continue
            if stretch:
                verify(stretch)
            stretch = (doc, item, a, b)
        verify(stretch)
        for (doc, item), (edits, end) in best.items():
            yield doc, self.ids[item], edits, int(self.size[item]), end


def item_blocks(items: DataFrame, block_items: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of about block_items rows, dealt by a hash of the whole row: what is held at once is bounded,
    whatever their number and however often a text repeats."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    n = max(1, -(-rows.count() // block_items))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, block_items: int = 4096) -> DataFrame:
    """Rows of LEAK_SCHEMA: one for each document and item that it leaks."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    found = None
    for block in item_blocks(items, block_items):
        part = rows.mapInArrow(leaks_of(block), LEAK_SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def leaks_of(block: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = LeakFinder(block)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            rows = []
            for a, b in slices_by_bytes([len(t) for t in texts], SLICE_CHARS):
                rows += [(ids[a + k], *rest) for k, *rest in finder.find(texts[a:b])]
            columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in LEAK_SCHEMA.split(", ")])

    return run


def drop_leaked(docs: DataFrame, items: DataFrame, block_items: int = 4096) -> DataFrame:
    """docs, all columns, without the rows whose text leaks an item. A null text leaks nothing; equal rows fare alike."""
    rows, (text,) = placed(docs, "text")
    place = rows.columns.index(text)

    def without(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = LeakFinder(block)
            for batch in batches:
                texts, keep = texts_of(batch.column(place)), np.ones(len(batch), bool)
                for a, b in slices_by_bytes([len(t) for t in texts], SLICE_CHARS):
                    keep[[a + k for k, *_ in finder.find(texts[a:b])]] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in item_blocks(items, block_items):
        rows = rows.mapInArrow(without(block), rows.schema)
    return rows.toDF(*docs.columns)
