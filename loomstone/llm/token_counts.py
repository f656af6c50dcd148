"""Token counts per field or section by offset-mapped attribution.

A document is encoded once, whole. The bytes of its tokens, laid end to end, are the document, so that their running
sum maps every token to a span; the spans are interval-joined to those of the sections by binary search over sorted
bounds, for all documents of a batch at once. A token that crosses a boundary is allocated by a stated rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.arrays import ranges, slices, text_bytes
from loomstone.llm.common import quoted

RULES = ("first", "last", "largest")


@lru_cache(maxsize=2)
def _encoding(ranks_path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and how many bytes each token has; one copy in each worker."""
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(begin: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token: ``begin`` and ``end`` are its span, ``bounds`` where each section begins, ascending and
    without gaps. ``first``: the section of its first unit; ``last``: of its last; ``largest``: the one that has most
    of it, the first among equals."""
    first = np.searchsorted(bounds, begin, "right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(bounds, end - 1, "right") - 1
    if rule == "last":
        return last
    out = first.copy()
    for k in np.flatnonzero(last > first):
        cuts = np.concatenate(([begin[k]], bounds[first[k] + 1 : last[k] + 1], [end[k]]))
        out[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return out


def line_sections(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line of each text begins, and the text it is of; a line ends with its line feed, and a text that is
    empty or ends in one has an empty last line."""
    feeds = np.flatnonzero(raw == 10) + 1
    owner = np.searchsorted(starts, feeds - 1, "right") - 1
    begin, text = np.concatenate((starts[:-1], feeds)), np.concatenate((np.arange(len(starts) - 1), owner))
    order = np.lexsort((begin, text))
    return begin[order], text[order]


def count_tokens(
    docs: DataFrame, ranks: str, pattern: str, rule: str = "first", fields: list[str] | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens): the tokens of each section of each row.

    ``ranks``: a file of byte-level ranks; ``pattern``: how it splits. Sections are the lines of ``text``, line feeds
    included, from 0. With ``fields``, the document is these columns in order with a line feed after each but the
    last, and the sections are the fields. ``rule`` is one of RULES, and the sum over sections is always the number
    of tokens of the whole document. Spans count code points.

    Null texts and fields are empty; an empty text is one empty section without tokens. Null and repeated ids and
    repeated rows have sections of their own. An empty table gives an empty table; other columns are not looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    feed = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    body: Column = F.concat_ws("\n", *map(feed, fields)) if fields else feed(text)
    lengths = F.array(*[F.octet_length(feed(c)).cast("long") for c in fields]) if fields else F.lit(None).cast("array<bigint>")
    rows = docs.select(quoted(doc_id).alias("id"), body.alias("text"), lengths.alias("lengths"))
    kind = rows.schema[0].dataType.simpleString()
    names = ["id", "section", "char_start", "char_end", "n_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, token_bytes = _encoding(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                raw, starts = text_bytes(texts)
                ids = [encoding.encode_to_numpy(t, disallowed_special=()) for t in texts.to_pylist()]
                sizes = token_bytes[np.concatenate(ids).astype(np.int64)] if ids else np.zeros(0, np.int64)
                end = np.cumsum(sizes)
                if fields:
                    each = np.asarray(part.column("lengths").flatten(), np.int64).reshape(-1, len(fields)) + 1
                    bounds = (starts[:-1, None] + np.cumsum(each, 1) - each).reshape(-1)
                    whose = np.repeat(np.arange(part.num_rows), len(fields))
                else:
                    bounds, whose = line_sections(raw, starts)
                # Bounds that coincide are empty sections; the last of them holds what follows.
                n = np.bincount(allocate(end - sizes, end, bounds, rule), minlength=len(bounds))
                # Code points before a byte: those that do not go on from the byte before.
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                close = np.append(bounds[1:], len(raw))
                base = points[starts[whose]]
                number = ranges(np.zeros(part.num_rows), np.bincount(whose, minlength=part.num_rows))
                columns = [part.column("id").take(pa.array(whose)), number.astype(np.int32), points[bounds] - base, points[close] - base, n]
                yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:])], names=names)

    counted = rows.mapInArrow(work, f"id {kind}, section int, char_start long, char_end long, n_tokens long")
    return counted.withColumnRenamed("id", doc_id)
