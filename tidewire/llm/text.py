"""Words and their hashes over whole Arrow batches, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D. These bytes
never occur inside a multi-byte UTF-8 character, so byte words are the words of
the text. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that separate words.
SPACE = " \t\n\x0b\x0c\r"

#: Odd multiplier of the rolling hashes (3 modulo 8) and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 1 << 64)

_U = np.uint64


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most `max_bytes` of text each (or one row)."""
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 row offsets; nulls are empty."""
    column = pa.array(column.fill_null("")) if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    out = np.full(max(n, 1), base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Which bytes are in words: all but white space.
VISIBLE = np.array([c not in SPACE.encode() for c in range(256)])
#: Which bytes are in words: ASCII letters and digits, and those of other characters.
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: A-Z in lower case, other bytes as they are.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Words:
    """Words of a batch of texts: byte spans, row of each word, first word of each row.

    `kinds` tells which bytes are in words.
    """

    def __init__(self, column: pa.Array, kinds: np.ndarray = VISIBLE):
        self.raw, self.offsets = utf8(column)
        raw = self.raw
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = kinds[raw]
        # A word starts or ends where the kind of byte changes, and at the rows' bounds.
        follows = inside[:-1].copy()
        follows[self.offsets] = False
        self.starts = np.flatnonzero(inside[1:] & ~follows)
        continues = inside[1:].copy()
        continues[self.offsets] = False
        self.ends = np.flatnonzero(inside[:-1] & ~continues)
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, lower: bool = False, first: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes: with A-Z in lower case, of its `first` bytes alone."""
        raw = LOWER[self.raw] if lower else self.raw
        ends = self.ends if first is None else np.minimum(self.ends, self.starts + first)
        n = len(raw)
        total = np.zeros(n + 1, _U)
        # Horner's rule backwards: the hash of a span is (T[s] - T[e]) * BASE**-s.
        np.cumsum((raw.astype(_U) + _U(1)) * powers(n), out=total[1:])
        span = (total[ends] - total[self.starts]) * powers(n + 1, INVERSE)[self.starts]
        return mix(span ^ (ends - self.starts).astype(_U))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes (rows aren't looked at; empty if there are fewer)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, _U)
    total = prefix(hashes)
    return mix((total[k:] - total[:-k]) * powers(n + 1, INVERSE)[: n - k + 1])


def prefix(hashes: np.ndarray) -> np.ndarray:
    """Sums from which `span` takes hashes of any run."""
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * powers(len(hashes)), out=total[1:])
    return total


def span(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end), from the sums of `prefix`."""
    return mix((total[end] - total[start]) * powers(len(total), INVERSE)[start])
