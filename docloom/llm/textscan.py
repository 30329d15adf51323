"""Vectorised word scanning over Arrow string columns, shared by the Arrow-based operators.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased: ASCII digits and
letters and every non-ASCII character. In UTF-8 that class is decided byte by byte, so a whole batch is scanned
with a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BYTE = np.arange(256)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
IS_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
#: Base of the polynomial word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Text is scanned in pieces of whole documents of about so many bytes, which bounds the scratch arrays.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, (n - 1).bit_length())
        table = np.ones(size, dtype=U64)
        table[1:] = U64(base)
        np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table[:n]


@dataclass
class Words:
    """Words of consecutive documents: begin/end are byte offsets into low, first[i]:first[i+1] are document i's words."""

    low: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.low)
        if not n or not len(self.begin):
            return np.zeros(0, dtype=U64)
        total = self.low.astype(U64)
        total += U64(1)
        total *= _power_table(_BASE, n)
        np.cumsum(total, out=total)
        out = total[self.end - 1]
        before = np.where(self.begin > 0, total[self.begin - 1], U64(0))
        out -= before
        out *= _power_table(_INVERSE, n)[self.begin]
        return mix(out)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, a: int, b: int) -> str:
        """Words a..b-1 joined by one space."""
        return " ".join(self.low[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.begin[a:b], self.end[a:b], strict=True))


def scan(buf: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(buf)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(buf, none, none, np.zeros(len(offsets), dtype=np.int64))
    word = IS_WORD[buf]
    starts = offsets[:-1]
    starts = starts[starts < n]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[starts] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[starts[starts > 0] - 1] = False
    begin = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return Words(LOWER[buf], begin, end, np.searchsorted(begin, offsets))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return body, at - at[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about size bytes."""
    body, at = utf8(column)
    n, a = len(at) - 1, 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(at, at[a] + size, side="right")) - 1))
        yield a, b, body[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries; entry i starts at word i. Empty if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out += h[j : j + n] * U64((2 * (j + 1) * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % (1 << 64) | 1)
    return mix(out + U64(k))


def within(first: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """For each start 0..n_words-k: whether the k words lie in one document."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[:n] == doc[k - 1 : k - 1 + n]
