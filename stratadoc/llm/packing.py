"""Hierarchical multi-length packing of token ids into training sequences.

Context tiers are the powers of two from `shortest` to `longest`. Each document's ids (and its end id) are
cut into pieces: full windows of the longest tier stand alone, and what remains is routed to the smallest
tier that holds it. The tiers are then packed from the longest down: a window takes one remainder of its own
tier, and its gap is filled from shorter tiers, the largest first; if no whole remainder fits, one
is cut, and the rest of it goes to its own, shorter tier. Windows are thus full. What the shortest tiers leave over
at the end of a buffer is carried to the next one; at the end of a task it is cut into windows by powers of two, so at most
one window a task, of under `shortest` ids, is padded.

Sequences of each tier are dealt in turn to step groups, each of one tier, that hold the same number of ids: a group takes
longest / tier times as many windows of a tier as of the longest. A task's last group of each tier may hold fewer.

Everything happens within a task, in the order in which the table is read: there is no shuffle, a task that
is run again gives the same rows, and memory is bounded by one buffer of documents plus the longest text.

Cases: a null or empty text is its end id alone. Equal rows are packed separately. A null doc_id stays null.
An empty table gives no row. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratadoc.llm.bpe import encoder, tokenizer_path
from stratadoc.llm.shared import texts_of

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


class Piece:
    """Consecutive ids of one document."""

    __slots__ = ("doc_id", "total", "start", "ids")

    def __init__(self, doc_id, total: int, start: int, ids: np.ndarray):
        self.doc_id, self.total, self.start, self.ids = doc_id, total, start, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.total, self.start, self.ids[:n]), Piece(self.doc_id, self.total, self.start + n, self.ids[n:])


class TierPacker:
    """Packs pieces into windows; `emit` receives (tier, pieces) for each finished window."""

    def __init__(self, emit, longest: int = 2048, shortest: int = 256):
        if longest & (longest - 1) or shortest & (shortest - 1) or not 0 < shortest <= longest:
            raise ValueError("tiers are powers of two")
        self.emit, self.longest, self.shortest = emit, longest, shortest
        self.tiers = [longest >> k for k in range((longest // shortest).bit_length())]
        self.pools: dict[int, deque[Piece]] = {t: deque() for t in self.tiers}
        self.sums = dict.fromkeys(self.tiers, 0)

    @property
    def held(self) -> int:
        return sum(self.sums.values())

    def route(self, piece: Piece) -> None:
        while len(piece.ids) >= self.longest:
            head, piece = piece.cut(self.longest)
            self.emit(self.longest, [head])
        if n := len(piece.ids):
            tier = max(self.shortest, 1 << (n - 1).bit_length())
            self.pools[tier].append(piece)
            self.sums[tier] += n

    def window(self, tier: int, sources: list[int]) -> None:
        """Emits one window from the sources, which hold tier ids or, at the very end, all that is left."""
        found, gap = [], tier
        while gap and (filled := [t for t in sources if self.pools[t]]):
            # the largest remainder that fits whole; else the smallest is cut
            source = next((t for t in filled if len(self.pools[t][0].ids) <= gap), filled[-1])
            piece = self.pools[source].popleft()
            self.sums[source] -= len(piece.ids)
            if len(piece.ids) > gap:
                piece, rest = piece.cut(gap)
                self.route(rest)
            found.append(piece)
            gap -= len(piece.ids)
        self.emit(tier, found)

    def drain(self) -> None:
        """Packs all tiers from the longest down, as far as full windows can be made."""
        for k, tier in enumerate(self.tiers):
            below = self.tiers[k:]
            while self.pools[tier] and sum(self.sums[t] for t in below) >= tier:
                self.window(tier, below)

    def finish(self) -> None:
        """Full windows by powers of two of what is left; the last one, under the shortest tier, is padded."""
        self.drain()
        for tier in self.tiers:
            while self.held >= tier:
                self.window(tier, self.tiers)
        if self.held:
            self.window(self.shortest, self.tiers)


class StepGroups:
    """Deals a tier's windows to its groups of equal ids: longest / tier times as many as of the longest."""

    def __init__(self, longest: int, windows: int):
        self.longest, self.windows = longest, windows
        self.dealt: dict[int, int] = {}

    def of(self, tier: int) -> int:
        n = self.dealt.get(tier, 0)
        self.dealt[tier] = n + 1
        return n // (self.windows * (self.longest // tier))


def pack_documents(df: DataFrame, path: str | None = None, end_id: int = 1, longest: int = 2048, shortest: int = 256, buffer_ids: int = 1 << 20, group_windows: int = 8, with_ids: bool = True) -> DataFrame:
    """Rows of PIECE_SCHEMA for df(doc_id, text): one per piece, ids as little-endian unsigned 32-bit bytes.

    sequence_id holds the task in its upper bits and is unique; offset is the piece's place in its sequence.
    """
    path = path or tokenizer_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(path).encode_all
        groups, rows, made = StepGroups(longest, group_windows), [], [0]

        def emit(tier: int, window: list[Piece]) -> None:
            sequence, offset, group = part << 33 | made[0], 0, part << 33 | groups.of(tier) * len(packer.tiers) + packer.tiers.index(tier)
            made[0] += 1
            for p in window:
                raw = p.ids.tobytes()
                rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.total, sequence, offset, tier, group, raw if with_ids else None))
                offset += len(p.ids)

        packer = TierPacker(emit, longest, shortest)
        drained = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts_of(batch.column(1)), end_id), strict=True):
                packer.route(Piece(doc_id, len(ids), 0, ids))
                if packer.held - drained >= buffer_ids:
                    packer.drain()
                    drained = packer.held
                if len(rows) >= 4000:
                    yield rows_batch(rows)
                    rows.clear()
        packer.finish()
        if rows:
            yield rows_batch(rows)

    return df.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(pack, PIECE_SCHEMA)


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=names)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The contract's rows, with the tier and step group of each piece's sequence."""
    return pack_documents(docs, with_ids=False).drop("ids")


__all__ = ["TierPacker", "pack_documents", "packed_pieces"]
