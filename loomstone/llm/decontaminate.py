"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of ten words (an item of fewer is one window), equal windows are merged, and each
window is cut into shingles of five. A window occurs in a document only if all its shingles do, so its rarest shingle alone
must be found: the necessary prefix for exact containment has length one. Rarity is the count of the shingle over all
documents. A document position with that shingle gives one place where the window could begin; places outside the document
(length and position bounds) fall away, and the words are compared one by one.

The documents are read twice, however large the benchmark: once to count its shingles, once to find the rarest ones. Both
times a bitmap of a fixed size keeps most other shingles from leaving the task. What is found, with the words around it,
meets the windows by shingle; while these are few, they go to the tasks, beyond that both sides are shuffled as plain
exchanges, which AQE can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.arrays import SpanHasher, combine, lowered, ranges, slices, text_bytes, word_spans
from loomstone.llm.common import fresh, quoted, wide_hash
from loomstone.session import cut

#: Words in a window and in a shingle.
WINDOW, SHINGLE = 10, 5
#: Bits of the bitmap of shingles, 8 MB; it passes the driver as at most 2**20 rows.
BITMAP = 26
#: Windows, items by window and contaminated texts go to every executor while there are at most so many.
BROADCAST_ROWS = 500_000

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words:
    """The words of many texts: bytes, spans, hashes, and the first word of each text."""

    def __init__(self, column: pa.Array) -> None:
        raw, starts = text_bytes(column)
        self.raw = lowered(raw)
        self.open, self.close, self.first = word_spans(self.raw, starts, _WORD)
        self.hash = SpanHasher(self.raw)(self.open, self.close)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``width`` consecutive words within one text, and the word at which each begins."""
        hashes = combine(self.hash, width)
        counts = np.maximum(np.diff(self.first) - width + 1, 0)
        at = ranges(self.first[:-1], counts)
        return hashes[at], at

    def joined(self, begin: np.ndarray, end: np.ndarray) -> list[str]:
        """The words from each ``begin`` to before ``end`` with a space between."""
        data, opens, closes = self.raw.tobytes(), self.open.tolist(), self.close.tolist()
        return [b" ".join([data[opens[k] : closes[k]] for k in range(a, b)]).decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, words, size) of each window of each row (item, text)."""
    kind = items.schema["item"]

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                counts = np.diff(words.first)
                sizes = np.minimum(counts, window)
                n = np.where(counts > 0, counts - sizes + 1, 0)
                begin, size = ranges(words.first[:-1], n), np.repeat(sizes, n)
                owner = part.column("item").take(pa.array(np.repeat(np.arange(part.num_rows), n)))
                yield pa.RecordBatch.from_arrays(
                    [owner, pa.array(words.joined(begin, begin + size), pa.string()), pa.array(size.astype(np.int32))], names=["item", "words", "size"]
                )

    return items.mapInArrow(work, T.StructType([kind, T.StructField("words", T.StringType()), T.StructField("size", T.IntegerType())]))


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, shingle, place) of each shingle of each row (window, words); a shorter window is one shingle."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "words"):
                words = Words(part.column("words"))
                sizes = np.diff(words.first)
                out = []
                for width in np.unique(np.minimum(sizes, shingle)).tolist():
                    mine = np.flatnonzero(np.minimum(sizes, shingle) == width)
                    places = sizes[mine] - width + 1
                    place = ranges(np.zeros(len(mine)), places)
                    hashes = combine(words.hash, width)[np.repeat(words.first[mine], places) + place]
                    out.append((np.repeat(mine, places), hashes, place))
                owner, hashes, place = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("window").take(pa.array(owner)), pa.array(hashes.view(np.int64)), pa.array(place.astype(np.int32))],
                    names=["window", "shingle", "place"],
                )

    return windows.select("window", "words").mapInArrow(work, "window long, shingle long, place int")


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """Which low bits the values of the column ``shingle`` have, as BITMAP-indexed booleans packed into bytes."""
    slot = F.col("shingle").bitwiseAND(F.lit((1 << BITMAP) - 1))
    word, bit = F.shiftright(slot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    found = shingles.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    out[np.asarray(found["word"])] = np.asarray(found["bits"])
    return out.view(np.uint8)


def _perhaps(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of the hashes whose bit is set; a few of them by chance."""
    slot = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def _count_shingles(texts: DataFrame, widths: list[int], bitmap) -> DataFrame:
    """(shingle, n): how often each shingle whose bit is set occurs in all rows (text)."""

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        values, back = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        return values, np.bincount(back, np.concatenate([n for _, n in held]), len(values)).astype(np.int64)

    def batch_of(held) -> pa.RecordBatch:
        values, n = rows(held)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                for width in widths:
                    hashes = words.shingles(width)[0]
                    held.append(np.unique(hashes[_perhaps(bitmap.value, hashes)], return_counts=True))
                    size += len(held[-1][0])
                if size > 1 << 20:
                    held = [rows(held)]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield batch_of(held)
                        held, size = [], 0
        if size:
            yield batch_of(held)

    return texts.mapInArrow(work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


_FOUND = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("base", pa.int32()), ("around", pa.string())])


def _find(rows: DataFrame, widths: list[int], before: int, after: int, bitmap) -> DataFrame:
    """``rows`` (..., text) without the text, with ``n_words`` and ``found``: each shingle whose bit is set, the word ``at``
    which it begins, and the words ``around`` it from the word ``base`` on."""
    kept = [c for c in rows.columns if c != "text"]

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                at, hashes = [], []
                for width in widths:
                    h, begin = words.shingles(width)
                    k = _perhaps(bitmap.value, h)
                    at.append(begin[k])
                    hashes.append(h[k])
                at, hashes = np.concatenate(at), np.concatenate(hashes)
                doc = np.searchsorted(words.first, at, "right") - 1
                order = np.argsort(doc, kind="stable")
                at, hashes, doc = at[order], hashes[order], doc[order]
                low, high = np.maximum(at - before, words.first[doc]), np.minimum(at + after, words.first[doc + 1])
                start = words.first[doc]
                values = [pa.array(hashes.view(np.int64)), pa.array((at - start).astype(np.int32)), pa.array((low - start).astype(np.int32))]
                found = pa.StructArray.from_arrays([*values, pa.array(words.joined(low, high), pa.string())], fields=list(_FOUND))
                offsets = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
                n_words = pa.array(np.diff(words.first).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], n_words, pa.ListArray.from_arrays(offsets, found)], names=[*kept, "n_words", "found"]
                )

    fields = [rows.schema[c] for c in kept]
    kind = "n_words long, found array<struct<shingle:bigint,at:int,base:int,around:string>>"
    return rows.mapInArrow(work, T.StructType([*fields, *T.StructType.fromDDL(kind)]))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked to go to all executors if it has few rows, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _occurrences(rows: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (..., text) as (..., n_words, row); each occurrence of a window (row, window, begin, end); (window, item)."""
    spark = rows.sparkSession
    every = cut(_windows(benchmark, window).distinct())
    windows = cut(every.groupBy("words", "size").agg(F.lit(0).alias("x")).select(F.monotonically_increasing_id().alias("window"), "words", "size"))
    shingles = cut(_window_shingles(windows, shingle))
    widths = sorted({min(shingle, r["size"]) for r in windows.groupBy(F.least("size", F.lit(shingle)).alias("size")).count().collect()}) or [shingle]

    bitmap = spark.sparkContext.broadcast(_bitmap(shingles))
    counts = cut(_count_shingles(rows.select("text"), widths, bitmap))
    rarity = shingles.join(counts, "shingle", "left").select("window", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle").alias("s"))
    # A window with a shingle that no document has occurs nowhere.
    first = rarity.groupBy("window").agg(F.min("s").alias("s")).filter("s.n > 0").select("window", "s.place", "s.shingle")
    prefix = cut(first.join(windows, "window"))

    bitmap = spark.sparkContext.broadcast(_bitmap(prefix))
    found = cut(_find(rows, widths, window - 1, window, bitmap)).withColumn("row", F.monotonically_increasing_id())
    places = found.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    begin = F.col("at") - F.col("place")
    own = F.array_join(F.slice(F.split("around", " "), F.greatest(begin - F.col("base"), F.lit(0)) + 1, F.col("size")), " ")
    inside = (begin >= F.col("base")) & (begin + F.col("size") <= F.col("n_words"))
    hits = (
        places.join(_small(prefix), "shingle")
        .filter(inside & (own == F.col("words")))
        .select("row", "window", begin.cast("long").alias("begin"), (begin + F.col("size")).cast("long").alias("end"))
    )
    return found.drop("found"), hits, every.join(windows, ["words", "size"]).select("window", "item")


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans sorted and joined where they meet or overlap."""
    if not len(begin):
        return begin, end
    order = np.lexsort((end, begin))
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > reach[:-1]))
    return begin[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(begin) - 1]))]


def _merge_spans(batches):
    longs = pa.list_(pa.int64())
    for batch in batches:
        spans = [_merged(*(np.array([s[k] for s in row], np.int64) for k in ("begin", "end"))) for row in batch.column("spans").to_pylist()]
        begins, ends = (pa.array([s[k].tolist() for s in spans], longs) for k in (0, 1))
        n_hit = pa.array([int((e - b).sum()) for b, e in spans], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), n_hit, begins, ends], names=["row", "n_hit", "begins", "ends"])


def _items(benchmark: DataFrame, item_text: str, item_id: str) -> DataFrame:
    return benchmark.select(quoted(item_id).alias("item"), quoted(item_text).cast("string").alias("text")).filter("text is not null")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, begins, ends) per row of ``docs``.

    A-Z are lower-cased; words are runs of letters a-z, digits and all beyond ASCII. A word is hit that lies in an
    occurrence of a window of ``window`` consecutive words of an item, or of a whole shorter item. ``items`` are the
    distinct ids, of any type, ascending with null last, of items with occurring windows; ``begins`` and ``ends`` the
    spans of words hit (end exclusive).

    A null or empty text has no words; an item without words has no window; items with one text are found together, and
    rows of the benchmark with one id are one item. Each row of ``docs`` has its own result, whether its id is null,
    repeated or neither. Tables may be empty. Other columns are not looked at.
    """
    rows = docs.select(quoted(doc_id).alias("id"), quoted(text).cast("string").alias("text"))
    found, hits, items = _occurrences(rows, _items(benchmark, item_text, item_id), window, shingle)
    hits, items = cut(hits), cut(items)
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    spans = spans.mapInArrow(_merge_spans, "row long, n_hit long, begins array<long>, ends array<long>")
    named = hits.select("row", "window").distinct().join(_small(items), "window").groupBy("row").agg(F.collect_set(F.struct("item")).alias("items"))
    none = F.array().cast("array<bigint>")
    return (
        found.join(spans, "row", "left")
        .join(named, "row", "left")
        .select(
            F.col("id").alias(doc_id),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.array_sort(F.col("items.item")), F.array().cast(T.ArrayType(items.schema["item"].dataType))).alias("items"),
            F.coalesce("begins", none).alias("begins"),
            F.coalesce("ends", none).alias("ends"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs.

    Texts alone decide, so that rows go by a 128-bit hash of their text; repeated rows go or stay together. Null and empty
    texts stay. Columns keep their names and values; an empty table stays empty.
    """
    t1, t2 = fresh(docs, "t1_", "t2_")
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    h1, h2 = wide_hash(body)
    rows = docs.select(h1.alias(t1), h2.alias(t2), quoted(text).cast("string").alias("text"))
    found, hits, _ = _occurrences(rows, _items(benchmark, item_text, item_id), WINDOW, SHINGLE)
    bad = cut(found.join(hits.select("row").distinct(), "row", "left_semi").select(t1, t2).distinct())
    marked = docs.withColumns({t1: h1, t2: h2})
    return marked.join(_small(bad), [t1, t2], "left_anti").select(*[quoted(c) for c in docs.columns])
