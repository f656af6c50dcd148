"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment verifies them.

Words are runs of letters and digits, A-Z in lower case; shingles are five words. A template of n shingles is of the
class of the least power of two c that is at least n. Texts are covered by windows of 2c shingles, a new one every c,
so that every passage of up to c + 1 shingles lies whole in a window, and a window that holds four fifths of a template
has at least a Jaccard similarity of 0.8 n / (2 c + 0.2 n), which is 0.19 or more. With BANDS bands of one minimum
each, such a window shares a band with the template with a probability of at least 1 - 0.81**64, over 0.999998. The
minima of larger windows come from those of smaller ones.

What a band retrieves is verified: the part of the template's shingles that the window, with half a class on either side,
holds must be at least 0.8. Hashes decide what is looked at closer, the words themselves what holds. Templates go to every
task, a block of bounded size after the other; texts do not move.
"""

from __future__ import annotations

import json
import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.arrays import SpanHasher, combine, lowered, mix, ranges, slices, text_bytes, word_spans
from loomstone.llm.common import quoted

SHINGLE, CONTAINED, BANDS = 5, 0.8, 64
#: At most so many templates in a block; their tables are a few kilobytes each.
MOST_TEMPLATES = 10_000

# Notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:"
    ),
}
# Notices and bodies of further common licenses, by SPDX name; bodies end in "-text" where a notice has the name.
TEMPLATES |= json.loads(pkgutil.get_data("loomstone.llm", "licenses.json"))

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Odd factors: each orders the hashes, which are well mixed before, in another way.
_FACTORS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOW = np.uint64(0xFFFF)
#: Bytes of text that are searched at a time; the arrays of a part stay in a core's cache.
PART_BYTES = 512 << 10


class Shingles:
    """All shingles of all texts: hashes, flat, and where each text's begin (one more than texts)."""

    def __init__(self, column: pa.Array) -> None:
        raw, starts = text_bytes(column)
        self.raw = lowered(raw)
        self.open, self.close, self.first = word_spans(self.raw, starts, _WORD)
        counts = np.maximum(np.diff(self.first) - SHINGLE + 1, 0)
        self.hashes = combine(SpanHasher(self.raw)(self.open, self.close), SHINGLE)[ranges(self.first[:-1], counts)]
        self.bounds = np.concatenate(([0], np.cumsum(counts)))

    def words(self, text: int, begin: int, end: int) -> set[tuple[bytes, ...]]:
        """The shingles at ``begin`` to before ``end`` of all, which are of this text, word by word."""
        at = self.first[text] + begin - self.bounds[text]
        own = [self.raw[a:b].tobytes() for a, b in zip(self.open[at : at + end - begin + SHINGLE - 1], self.close[at:], strict=False)]
        return set(zip(*[own[k : k + end - begin] for k in range(SHINGLE)], strict=True))


class Templates:
    """Shingle sets of the templates, and by class and band the minima that retrieve them, sorted."""

    def __init__(self, texts: dict[str, str]) -> None:
        made = Shingles(pa.array(list(texts.values()), pa.string()))
        hashes, bounds = made.hashes, made.bounds
        sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kept = [k for k, s in enumerate(sets) if len(s)]
        self.names = [list(texts)[k] for k in kept]
        self.sets = [sets[k] for k in kept]
        self.words = [made.words(k, bounds[k], bounds[k + 1]) for k in kept]
        self.sizes = [int(bounds[k + 1] - bounds[k]) for k in kept]
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for c in sorted({self._class(n) for n in self.sizes}):
            mine = np.array([k for k, n in enumerate(self.sizes) if self._class(n) == c])
            bands = []
            for factor in _FACTORS:
                minima = np.array([(self.sets[k] * factor).min() for k in mine])
                order = np.argsort(minima)
                # Which low halves occur: a look that most windows do not pass.
                seen = np.zeros(1 << 16, bool)
                seen[minima & _LOW] = True
                bands.append((minima[order], mine[order], seen))
            self.classes[c] = bands

    @staticmethod
    def _class(n: int) -> int:
        return 1 << (n - 1).bit_length()


def _windows(bounds: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of c shingles within texts: where each begins, and the text; a text's last block may be shorter."""
    counts = -(-np.diff(bounds) // c)
    text = np.repeat(np.arange(len(counts)), counts)
    return bounds[text] + c * ranges(np.zeros(len(counts)), counts), text


def _over(bounds: np.ndarray, small: int, large: int) -> np.ndarray:
    """For each window of class ``large``, the first of the windows of class ``small`` that it is made of."""
    n = np.diff(bounds)
    counts, first = -(-n // large), np.concatenate(([0], np.cumsum(-(-n // small))[:-1]))
    return np.repeat(first, counts) + large // small * ranges(np.zeros(len(n)), counts)


def find_templates(column: pa.Array, templates: Templates, banded: bool = True) -> list[tuple[int, int, float, int]]:
    """(text, template, containment, shingle at which the window begins) of the best window of each template that a text
    holds, by text and template. ``banded`` false verifies every window with every template of its class."""
    made = Shingles(column)
    hashes, bounds = made.hashes, made.bounds
    if not len(hashes):
        return []
    candidates: dict[tuple[int, int], set[int]] = {}
    layout = {c: _windows(bounds, c) for c in templates.classes}
    if banded:
        paired = {c: np.append(text[1:] == text[:-1], False) for c, (_, text) in layout.items()}
        order = [1, *(c for c in templates.classes if c > 1)]
        over = {large: _over(bounds, small, large) for small, large in zip(order[:-1], order[1:], strict=True)}
        for band, factor in enumerate(_FACTORS):
            blocks = hashes * factor
            for c, bands in templates.classes.items():
                blocks = blocks if c == 1 else np.minimum.reduceat(blocks, over[c])
                pairs = blocks.copy()
                np.minimum(blocks[:-1], blocks[1:], out=pairs[:-1], where=paired[c][:-1])
                minima, owners, seen = bands[band]
                for k in np.flatnonzero(seen[pairs & _LOW]).tolist():
                    low, high = np.searchsorted(minima, pairs[k]), np.searchsorted(minima, pairs[k], "right")
                    for owner in owners[low:high].tolist():
                        candidates.setdefault((c, owner), set()).add(k)
    else:
        for c, bands in templates.classes.items():
            for owner in bands[0][1].tolist():
                candidates[c, owner] = set(range(len(layout[c][0])))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for (c, owner), windows in candidates.items():
        begin, text = layout[c]
        wanted = templates.sets[owner]
        for k in sorted(windows):
            t = int(text[k])
            a, b = max(bounds[t], begin[k] - c // 2), min(bounds[t + 1], begin[k] + 2 * c + c // 2)
            share = float(np.isin(wanted, hashes[a:b]).mean())
            if share >= CONTAINED and share > best.get((t, owner), (0.0, 0))[0]:
                exact = templates.words[owner]
                share = len(exact & made.words(t, int(a), int(b))) / len(exact)
            if share >= CONTAINED and share > best.get((t, owner), (0.0, 0))[0]:
                best[t, owner] = (share, int(begin[k] - bounds[t]))
    return [(t, owner, *found) for (t, owner), found in sorted(best.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, licenses) per row: an array of (name, containment, word), by name's place in ``templates``; ``word`` is
    the word at which the window begins that holds most of the template's shingles.

    Null, empty and short texts hold nothing; templates of fewer than five words are never found. Null and repeated
    ids and repeated rows are rows of their own; an empty table gives an empty table; other columns are not looked at.
    """
    rows = docs.select(quoted(doc_id).alias("id"), quoted(text).cast("string").alias("text"))
    every = list((TEMPLATES if templates is None else templates).items())
    found = rows.withColumn("licenses", F.array().cast(_LICENSES))
    for k in range(0, len(every), MOST_TEMPLATES):
        found = _add_found(found, dict(every[k : k + MOST_TEMPLATES]))
    return found.select(F.col("id").alias(doc_id), "licenses")


_LICENSES = "array<struct<name:string,containment:double,word:bigint>>"


def _add_found(rows: DataFrame, templates: dict[str, str]) -> DataFrame:
    """``rows`` (id, text, licenses) with what these templates add."""
    shared = rows.sparkSession.sparkContext.broadcast(Templates(templates))
    kind = pa.list_(pa.struct([("name", pa.string()), ("containment", pa.float64()), ("word", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                out: list[list[dict]] = part.column("licenses").to_pylist()
                for t, owner, share, word in find_templates(part.column("text"), known):
                    out[t].append({"name": known.names[owner], "containment": share, "word": word})
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), pa.array(out, kind)], names=["id", "text", "licenses"])

    return rows.mapInArrow(work, rows.schema)
