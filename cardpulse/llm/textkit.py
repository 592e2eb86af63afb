"""Vectorised word and shingle hashing over Arrow string columns.

Everything works on the UTF-8 buffer of a column at once: a byte class table marks separators, words are
the runs between them, and a word's 64-bit hash is a polynomial over its bytes read off a running sum.
Texts are never joined: a separator is placed between neighbours. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed in one step; a longer single text is a step of its own.
STEP_BYTES = 1 << 18

_U = np.uint64
#: Odd multiplier of the polynomial and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """Another member of the hash family: independent of ``mix`` for another salt."""
    return mix(x ^ mix(np.array([salt + 1], dtype=_U) * _U(0xD6E8FEB86659FD93)))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        step = np.full(size, _BASE if which == "up" else _INVERSE, dtype=_U)
        step[0] = 1
        have = _powers[which] = np.cumprod(step)
    return have[:n]


def separators(negated: str) -> np.ndarray:
    """Byte table (True: separator) of the contract classes: ``space`` for ``[^\\x20\\x09-\\x0D]+`` words and
    ``ascii`` for ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` words of lower-cased text."""
    table = np.zeros(256, dtype=bool)
    ranges = {"space": [(0x20, 0x20), (0x09, 0x0D)], "ascii": [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]}[negated]
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Byte map that lower-cases A-Z and leaves the rest of UTF-8 alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 of all texts end to end and where each begins; null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    _, ends, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets.astype(np.int64) - int(offsets[0])


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) with at most ``most`` bytes each, or a single row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """Words of a range of texts: ``hash`` (uint64 each), ``start``/``end`` (bytes in ``data``), ``first`` (index of
    each text's first word, one more at the end)."""

    __slots__ = ("data", "end", "first", "hash", "start", "total")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, lower: bool):
        rows = len(offsets) - 1
        gap = np.zeros(len(data) + rows, dtype=np.uint8)
        gap.fill(0x20)  # a separator in every class, after each text
        at = np.arange(len(data), dtype=np.int64) + np.repeat(np.arange(rows), np.diff(offsets)) if rows > 1 else slice(0, len(data))
        gap[at] = LOWER[data] if lower else data
        self.data = gap
        inside = ~separator[gap]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, np.append((offsets[:-1] + np.arange(rows)), len(gap)))
        self.total = np.zeros(len(gap) + 1, dtype=_U)
        np.cumsum(_BYTE[gap] * _power("up", len(gap)), out=self.total[1:])
        self.hash = self.between(self.start, self.end)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range of ``data``."""
        return mix((self.total[end] - self.total[start]) * _power("down", len(self.total))[start])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of every run of ``n`` characters (code points) within a word."""
        lead = (self.data & 0xC0) != 0x80
        size = self.end - self.start
        byte = np.repeat(self.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        word = np.repeat(np.arange(len(size)), size)
        whole = lead[byte]
        byte, word = byte[whole], word[whole]
        if len(byte) < n:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        same = word[: len(word) - n + 1] == word[n - 1 :]
        following = np.append(np.where(np.append(word[1:] == word[:-1], False), np.append(byte[1:], 0), self.end[word]), 0)
        return word[: len(same)][same], self.between(byte[: len(same)][same], following[n - 1 : n - 1 + len(same)][same])


def each_words(texts: pa.Array, kind: str, lower: bool, most: int = STEP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) over all texts of a column, a bounded step at a time."""
    data, offsets = column_bytes(texts)
    table = separators(kind)
    for a, b in steps(offsets, most):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table, lower)


def windows(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive hashes (also across text borders: the caller masks those).
    Built by doubling, so the cost grows with log(size)."""
    if len(hashes) < size:
        return np.zeros(0, dtype=_U)
    out, have = None, 0
    block, width, left = salted(hashes, salt) if salt else hashes, 1, size
    while left:
        if left & 1:
            out = block[: len(hashes) - size + 1] if out is None else mix(out * _U(_BASE) + block[have : have + len(hashes) - size + 1])
            have += width
        left >>= 1
        if left:
            block = mix(block[: len(block) - width] * _U(0xC2B2AE3D27D4EB4F) + block[width:])
            width *= 2
    return out
