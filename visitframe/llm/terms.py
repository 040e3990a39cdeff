"""Words of Arrow text columns in pieces of bounded size, also where one text is longer than a piece.

A piece holds a run of whole rows, or a part of one long row cut between two words. So numpy work stays within a
bound whatever the length of a text (one single word longer than a piece is the only exception).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from visitframe.llm.blocks import BLOCK_BYTES, LOWER, Words, _powers, mix, text_blocks

_U = np.uint64


@dataclass
class Piece:
    """Rows `first` to `first + rows` of a batch, or a part of row `first` whose earlier parts held `before` words."""

    first: int
    rows: int
    data: np.ndarray
    words: Words
    before: int = 0
    begins: bool = True  # holds the beginning of its rows
    last: bool = True    # holds their end


class Spans:
    """Hash of any span of a sequence of 64-bit values, from one array of prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = _powers(max(BLOCK_BYTES, 1 << int(n + 1).bit_length()))
        self.prefix = np.zeros(n + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum((values + _U(1)) * up[:n], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[start]) * self.down[start])


def cut_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """Words of rows, as the bytes stand; a word never reaches over a row's end."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = word_bytes[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here & (~before | cut))
    end = np.flatnonzero(before & (~here | cut))
    return Words(Spans(data.astype(_U)).hash(start, end), start, end, np.searchsorted(start, offsets))


def pieces(column: pa.Array, word_bytes: np.ndarray, lower: bool, max_bytes: int = BLOCK_BYTES) -> Iterator[Piece]:
    """Pieces of a text column in order; a null text is an empty one."""
    for lo, hi, data, offsets in text_blocks(column, max_bytes):
        if lower:
            data = LOWER[data]
        if len(data) <= max_bytes or hi - lo > 1:
            yield Piece(lo, hi - lo, data, cut_words(data, offsets, word_bytes))
            continue
        at, seen = 0, 0
        while at < len(data):
            end = min(at + max_bytes, len(data))
            gaps = np.flatnonzero(~word_bytes[data[at:end]])
            if end < len(data):
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # a word longer than a piece: go on to its end
                    while end < len(data) and word_bytes[data[end]]:
                        end += 1
            part = data[at:end]
            words = cut_words(part, np.array([0, len(part)]), word_bytes)
            yield Piece(lo, 1, part, words, seen, at == 0, end >= len(data))
            at, seen = end, seen + len(words.hash)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray, gap: int = 0, fill: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given spans one after the other, each followed by `gap` bytes of `fill`; and where each begins."""
    begin = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length + gap, out=begin[1:])
    out = np.full(int(begin[-1]), fill, np.uint8)
    shift = np.repeat(begin[:-1] - start, length)
    source = np.arange(int(length.sum())) + np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if len(start) else np.zeros(0, np.int64)
    out[source + shift] = data[source]
    return out, begin
