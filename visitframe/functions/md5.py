"""md5 of many short numbered texts at once, for draws that a SQL engine can repeat."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_TURN = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SINE = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_BLOCK = 55     # bytes of a text that fits one md5 block


def leading_draws(head: bytes, lo: int, hi: int, tail: bytes) -> np.ndarray:
    """The first 15 hex digits of md5(head + number + tail), as whole numbers, for the numbers lo to hi - 1."""
    out = np.empty(hi - lo, np.int64)
    while lo < hi:
        digits = len(str(lo))
        end = min(hi, 10**digits)
        at = slice(len(out) - (hi - lo), len(out) - (hi - end))
        if len(head) + digits + len(tail) > _BLOCK:
            out[at] = [int(hashlib.md5(head + str(i).encode() + tail).hexdigest()[:15], 16) for i in range(lo, end)]
        else:
            out[at] = _one_block(head, np.arange(lo, end, dtype=np.int64), digits, tail)
        lo = end
    return out


def _one_block(head: bytes, numbers: np.ndarray, digits: int, tail: bytes) -> np.ndarray:
    size = len(head) + digits + len(tail)
    plain = head + b"0" * digits + tail + b"\x80"
    plain = plain.ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
    words: list = [np.uint32(w) for w in np.frombuffer(plain, "<u4")]
    left = numbers
    for k in reversed(range(digits)):   # digits above "0" are added to the words they fall in
        left, digit = np.divmod(left, 10)
        byte = len(head) + k
        words[byte // 4] = words[byte // 4] + (digit.astype(np.uint32) << np.uint32(8 * (byte % 4)))
    a, b, c, d = (np.full(len(numbers), v, np.uint32) for v in _START)
    with np.errstate(over="ignore"):
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += words[g] + _SINE[i]
            turn = _TURN[i // 16][i % 4]
            turned = f << np.uint32(turn)
            f >>= np.uint32(32 - turn)
            turned |= f
            turned += b
            a, d, c, b = d, c, b, turned
        a, b = a + _START[0], b + _START[1]
    return (a.byteswap().astype(np.int64) << 28) | (b.byteswap().astype(np.int64) >> 4)
