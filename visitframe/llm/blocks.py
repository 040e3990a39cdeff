"""Vectorised text work inside Arrow tasks: words, their hashes and shingles straight from UTF-8 bytes.

A task sees its rows as Arrow record batches. `text_blocks` cuts a batch into
runs of rows with a bounded number of bytes, so the numpy work of one step stays
small whatever the batch size (a single longer text is a block of its own).
Both word patterns used here exclude only ASCII characters, so they can be
decided byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
ROW_BITS = 12
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()
#: word bytes of `[^\x20\x09-\x0D]+`
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    if not large and column.type != pa.string():
        column = column.cast(pa.string())
    _, offs, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offs, dtype=kind)[column.offset: column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets


def text_blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES, max_rows: int = 2**ROW_BITS - 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of at most `max_bytes` and `max_rows`, one row at least."""
    data, offsets = string_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1), lo + max_rows)
        yield lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(size, _U(_BASE & (2**64 - 1)))
        down = np.full(size, _U(pow(_BASE, -1, 2**64)))
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift, multiply, shift)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


@dataclass
class Words:
    """Words of a block: 64-bit hash, byte range, and per row the first word."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row_start: np.ndarray  # rows + 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.row_start)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_start) - 1), self.count)


def words_of(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """All words of a block. A word never reaches over a row's end."""
    data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = word_bytes[data]
    cut = np.zeros(n + 1, dtype=bool)  # a row begins at this byte
    cut[offsets] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here & (~before | cut))
    end = np.flatnonzero(before & (~here | cut))
    up, down = _powers(max(BLOCK_BYTES, 1 << int(n).bit_length()))
    prefix = np.zeros(n + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=prefix[1:])
        h = mix((prefix[end] - prefix[start]) * down[start])
    return Words(h, start, end, np.searchsorted(start, offsets))


def hash_words(texts: list[str | None], word_bytes: np.ndarray) -> Words:
    column = pa.array(texts, pa.string())
    data, offsets = string_buffers(column)
    return words_of(data[offsets[0]: offsets[-1]], offsets - offsets[0], word_bytes)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, as (hashes sorted within the row, row boundaries).

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    rows, count = len(w.row_start) - 1, w.count
    total = len(w.hash)
    with np.errstate(over="ignore"):
        padded = np.concatenate([w.hash, np.zeros(k, _U)])
        h = np.zeros(total, dtype=_U)
        for j in range(k):
            h = (h ^ padded[j: j + total]) * _U(0xD6E8FEB86659FD93) + _U(2 * j + 1)
    row = w.row_of()
    place = np.arange(total) - w.row_start[:-1][row]
    keep = place <= count[row] - k
    short = np.flatnonzero((count > 0) & (count < k))
    for r in short:  # at most k - 1 words each
        v = 0
        for j, x in enumerate(w.hash[w.row_start[r]: w.row_start[r + 1]].tolist()):
            v = ((v ^ x) * 0xD6E8FEB86659FD93 + 2 * j + 1) & (2**64 - 1)
        h[w.row_start[r]] = v ^ 0x5851F42D4C957F2D
        keep[w.row_start[r]] = True
    h, row = mix(h[keep]), row[keep]
    # the row number takes the leading bits, the other 52 stay hash (the same in every block)
    bits = _U(ROW_BITS)
    key = np.sort((row.astype(_U) << (_U(64) - bits)) | (h >> bits))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key, np.arange(rows + 1, dtype=_U) << (_U(64) - bits))
    return mix(key << bits), bounds
