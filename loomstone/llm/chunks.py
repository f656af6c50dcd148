"""Texts as runs of bytes between ASCII white space, each distinct run encoded once.

For a tokenizer that drops white space and never joins what it separates, the ids of a text are those of its runs in
order. Workers keep the ids of runs they have met, up to a bound. Where the tokenizer also lower-cases and parts
letters and digits from punctuation, runs are made alike first: A-Z in lower case, punctuation a run by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa

from loomstone.llm.arrays import ranges, text_bytes

#: What a worker remembers: so many runs and bytes of them; beyond, it starts anew with the next batch.
MOST_RUNS, MOST_BYTES = 600_000, 32 << 20


_UPPER, _SOLID, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_SOLID[[*range(48, 58), *range(97, 123)]] = True
#: All ASCII punctuation but the apostrophe, with which contractions begin.
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True


def alike(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z in lower case and a space between a letter or digit and a mark that follows it.

    A letter that a byte beyond ASCII follows, perhaps a combining mark, stays as it is. Bytes that hold ``<|``, with
    which special tokens begin, stay altogether.
    """
    if len(raw) < 2 or ((raw[:-1] == 60) & (raw[1:] == 124)).any():
        return raw, starts
    raw = raw.copy()
    raw[:-1][_UPPER[raw[:-1]] & (raw[1:] < 128)] |= 32
    gaps = np.flatnonzero(_SOLID[raw[:-1]] & _MARK[raw[1:]]) + 1
    return np.insert(raw, gaps, 32), starts + np.searchsorted(gaps, starts)


class ChunkEncoder:
    """Encodes batches of texts; ``encode`` maps distinct runs to their ids, flat, and how many each run has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.held = 0

    def _add(self, runs: list[bytes]) -> None:
        ids, sizes = self.encode(runs)
        self.held += sum(map(len, runs))
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, flat, and how many each text has; null is empty."""
        raw, starts = alike(*text_bytes(column))
        data = raw.tobytes()
        if len(self.place) > MOST_RUNS or self.held > MOST_BYTES:
            self.forget()
        place, known, at, counts = self.place, len(self.place), [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            runs = data[a:b].split()
            counts.append(len(runs))
            at += [place.setdefault(r, len(place)) for r in runs]
        if len(place) > known:
            self._add(list(islice(place, known, None)))
        at = np.asarray(at, np.int64)
        flat = self.ids[ranges(self.begin[at], self.size[at])]
        ends = np.concatenate(([0], np.cumsum(self.size[at])))
        return flat, np.diff(ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))])
