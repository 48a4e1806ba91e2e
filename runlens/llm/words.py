"""Vectorised words and 64-bit word hashes over the UTF-8 buffer of an Arrow string column.

All functions work on a chunk of whole texts laid end to end: ``data`` (uint8) and ``offsets`` (text i is
``data[offsets[i]:offsets[i+1]]``). Nulls count as empty texts. Working memory stays near ten bytes a byte of
the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 2 << 20


def _lower(keep: np.ndarray) -> np.ndarray:
    """Byte -> lower-cased byte plus nothing, or 0 where the byte separates words (0 itself always does or maps to 1)."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[~keep] = 0
    return table


def space_words() -> np.ndarray:
    r"""Words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z."""
    keep = np.ones(256, bool)
    keep[[0x20, 9, 10, 11, 12, 13]] = False
    return keep


def alnum_words() -> np.ndarray:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters and all beyond ASCII."""
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x61:0x7B] = keep[0x41:0x5B] = keep[0x80:] = True
    return keep


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) of runs of whole texts of about ``limit`` bytes; a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Word boundaries of a chunk: byte ranges ``start``/``end`` and ``first`` (text i has words first[i]:first[i+1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
        inside = keep[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        begin[heads] = inside[heads]  # a text's first byte never continues the text before
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        stop[tails] = inside[tails]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.data = data

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1, lower-cased, joined by single spaces."""
        return b" ".join(LOWER[self.data[a:b]].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each lower-cased word."""
        return span_hashes(self.data, self.start, self.end, LOWER)


#: Words of more bytes are hashed by blake2b, one by one.
_LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges, of bytes mapped by ``table``.

    Eight bytes are mixed in at a time, so ranges of up to eight bytes and one length never share a hash, and for
    longer ones no structure of the bytes (as in words that are repetitive) makes a clash likelier than chance.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data if table is None else table[data]
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = end - start
    out = np.zeros(len(start), U)
    at, done = np.flatnonzero(size <= _LONG), 0
    while len(at):
        block = eight[start[at] + done] & _MASKS[np.minimum(size[at] - done, 8)]
        out[at] = mix(out[at] * U(3) + block + U(0x9E3779B97F4A7C15))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8).digest(), "little")
    return mix(out ^ (size.astype(U) << U(48)))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (fixed values)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), U)
    for k in range(size if n > 0 else 0):
        out = mix(out * U(3) + hashes[k : k + n])
    return out
