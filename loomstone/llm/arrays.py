"""Whole batches of texts as flat numpy arrays: bytes, words and rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd, so that powers of it can be undone modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more than texts); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[raw]


def word_spans(raw: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of word bytes, none across texts, and how many words precede each text."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = is_word[raw]
    change = inside[1:] != inside[:-1]
    change[starts[(starts > 0) & (starts < len(raw))]] |= inside[1:-1][starts[(starts > 0) & (starts < len(raw))]]
    opens = np.flatnonzero(change & inside[1:])
    before = inside[:-1]
    closes = np.flatnonzero(change & before)
    return opens, closes, np.searchsorted(opens, starts)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class SpanHasher:
    """Hashes of any spans of one byte array from a single running sum; equal bytes have equal hashes.

    A hash is the polynomial of the span's bytes modulo 2**64, mixed. Who needs certainty compares the bytes.
    """

    def __init__(self, raw: np.ndarray) -> None:
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw)), out=self.sums[1:])
        self.undo = powers(len(raw) + 1, _BASE_INVERSE)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.undo[begin])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` consecutive hashes, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out * BASE + hashes[k : k + n])
    return out


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0]+length[0]-1, begin[1] .., flat."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(begin, np.int64) - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return shift + np.arange(total, dtype=np.int64)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """Parts of ``batch`` of about ``most_bytes`` of text each; a longer text is a part by itself."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to
