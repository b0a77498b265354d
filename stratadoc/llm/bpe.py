"""Byte-level BPE ids of whole texts through the tokenizers library; each distinct piece between blanks is encoded once a slice.

The byte-level pre-tokenizer never lets a token cross the border in front of a blank that is followed by
something other than white space. Texts are therefore cut there: a slice of texts is split and its distinct pieces are
found in Arrow, pieces that the worker's memo does not hold go to the library many at a time, and the ids of all texts
are gathered in numpy. Within a joined string of pieces, a token that starts with a blank starts a piece. Texts in which
a blank is followed by more white space are encoded whole, so the ids always equal those of one call on each whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stratadoc.llm.shared import slices_by_bytes

BLANK_RUN = re.compile(r" \s| $")
#: Text bytes of a slice; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Pieces that a worker keeps from slice to slice, those met most often, and the longest of them in bytes.
MEMO_PIECES, MEMO_PIECE_BYTES = 150_000, 64
#: Pieces in one string for the library.
JOINED = 64


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of each pair, one after another."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self.n_ids = self._tokenizer.get_vocab_size()
        blank = self._tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self._opens = np.zeros(self.n_ids, bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._opens[i] = token.startswith(blank)
        self._words = pa.array([], pa.large_string())
        self._scores, self._lengths, self._pool = np.empty(0), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their numbers)."""
        made = [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *made]), np.array([len(m) for m in made], np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, each after a blank; their numbers)."""
        joined = [" " + " ".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        ids = np.concatenate([np.empty(0, np.uint32), *(self._library(joined[i : i + 256])[0] for i in range(0, len(joined), 256))])
        opened = np.flatnonzero(self._opens[ids])
        if len(opened) != len(pieces):
            raise ValueError("the vocabulary lets a token cross the border in front of a blank")
        return ids, np.diff(opened, append=len(ids))

    def encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unsigned 32-bit ids of all texts, one after another; their numbers)."""
        whole = [BLANK_RUN.search(t) is not None for t in texts]
        split = pc.split_pattern(pa.array(["" if w else t for w, t in zip(whole, texts, strict=True)], pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        offsets = split.offsets.to_numpy()
        # a text's first piece has no blank before it and is encoded by itself
        codes[offsets[:-1]] = len(words) + np.arange(len(texts))
        first_ids, first_lengths = self._library([t if w else t.partition(" ")[0] for w, t in zip(whole, texts, strict=True)])
        times = np.bincount(codes, minlength=len(words) + len(texts))[: len(words)]
        used = np.flatnonzero(times)
        words, times = words.take(pa.array(used)), times[used]
        place = np.empty(len(coded.dictionary) + len(texts), np.int64)
        place[used] = np.arange(len(used))
        place[len(coded.dictionary) :] = len(used) + np.arange(len(texts))

        held = pc.index_in(words, value_set=self._words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(held < 0)
        new_ids, new_lengths = self._pieces(words.take(pa.array(new)).to_pylist())
        memo_starts = np.cumsum(self._lengths) - self._lengths
        pool = np.concatenate([self._pool, new_ids, first_ids])
        lengths, starts = np.empty(len(used) + len(texts), np.int64), np.empty(len(used) + len(texts), np.int64)
        old = np.flatnonzero(held >= 0)
        lengths[old], starts[old] = self._lengths[held[old]], memo_starts[held[old]]
        lengths[new], starts[new] = new_lengths, len(self._pool) + np.cumsum(new_lengths) - new_lengths
        lengths[len(used) :], starts[len(used) :] = first_lengths, len(self._pool) + len(new_ids) + np.cumsum(first_lengths) - first_lengths
        rows = place[codes]
        each = lengths[rows]
        ids = ragged(pool, starts[rows], each)
        ends = np.concatenate([[0], np.cumsum(each)])[offsets]
        self._remember(words, times, held, lengths, starts, pool, memo_starts)
        return ids, np.diff(ends)

    def _remember(self, words: pa.Array, times: np.ndarray, held: np.ndarray, lengths: np.ndarray, starts: np.ndarray, pool: np.ndarray, memo_starts: np.ndarray) -> None:
        """The memo becomes the pieces of the highest scores: their times in the slices so far, halved after each."""
        scores = times.astype(float)
        scores[held >= 0] += self._scores[held[held >= 0]] / 2
        absent = np.setdiff1d(np.arange(len(self._words)), held, assume_unique=True)
        every = pa.concat_arrays([words, self._words.take(pa.array(absent))])
        scores = np.concatenate([scores, self._scores[absent] / 2])
        starts, lengths = np.concatenate([starts[: len(words)], memo_starts[absent]]), np.concatenate([lengths[: len(words)], self._lengths[absent]])
        kept = np.flatnonzero((scores > 1) & (pc.binary_length(every).to_numpy() <= MEMO_PIECE_BYTES))
        if len(kept) > MEMO_PIECES:
            kept = kept[np.argpartition(-scores[kept], MEMO_PIECES)[:MEMO_PIECES]]
        self._words, self._scores, self._lengths = every.take(pa.array(kept)), scores[kept], lengths[kept]
        self._pool = ragged(pool, starts[kept], lengths[kept])

    def encode_all(self, texts: list[str], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text and end_id, in order."""
        end = np.array([end_id], np.uint32)
        for start, stop in slices_by_bytes([len(t) for t in texts], SLICE_BYTES):
            ids, lengths = self.encode_slice(texts[start:stop])
            at = 0
            for n in lengths.tolist():
                yield np.concatenate([ids[at : at + n], end])
                at += n


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; kept, as workers are reused."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
