"""Bloom filters as tables of bitmaps, prefix lookup of digests, approximate aggregates, and nearest vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bloom:
    """The shape of a filter for ``n`` values with a rate ``p`` of false positives."""

    n: int
    p: float

    @property
    def bits(self) -> int:
        return max(64, math.ceil(-self.n * math.log(self.p) / math.log(2) ** 2))

    @property
    def hashes(self) -> int:
        return max(1, round(self.bits / self.n * math.log(2)))

    def positions(self, value: Column) -> Column:
        """The bits of a value, one per hash."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), value), F.lit(self.bits)) for i in range(self.hashes)])


def build(values: DataFrame, value: Column, shape: Bloom) -> DataFrame:
    """(bucket, bits): the filter as one bitmap per 32768 bits, made by partial aggregation."""
    at = values.select(F.explode(shape.positions(value)).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of the values of both."""
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def probe(df: DataFrame, value: Column, bloom: DataFrame, shape: Bloom, out: str = "maybe") -> DataFrame:
    """``df`` with ``out``: whether the filter may have the value. The filter, of fixed size, goes to every task."""
    table = bloom.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("bloom_"))

    def has(at: Column) -> Column:
        place = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substring(F.try_element_at("bloom_", F.bitmap_bucket_number(at)), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))

    return df.join(F.broadcast(table)).withColumn(out, F.forall(shape.positions(value), has)).drop("bloom_")


def with_prefix(digests: DataFrame, column: str, prefix: str) -> DataFrame:
    """The rows whose hexadecimal digest begins with ``prefix``: a range that reaches the scan."""
    return digests.filter(F.col(column).startswith(prefix))


def approximate(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Approximate distinct count, median and most frequent values of a column per group."""
    return df.groupBy(*by).agg(
        F.approx_count_distinct(column, 0.02).alias("distinct"),
        F.percentile_approx(column, 0.5, 10_000).alias("median"),
        F.hll_sketch_estimate(F.hll_sketch_agg(column)).alias("hll"),
    )


def fuzzy_search(terms: DataFrame, queries: DataFrame, term: str, query: str, radius: int) -> DataFrame:
    """Pairs of a query and a term at most ``radius`` edits apart, with ``distance``.

    Joined on deletion neighbourhoods: texts within the radius share a form with at most that many characters left
    out. Meant for words; a word of n characters has about n**radius forms.
    """
    forms = F.array_distinct(_deletions(F.col("t_"), radius))
    a = terms.select(F.col(term).alias("t_")).distinct().withColumn("form_", F.explode(forms))
    b = queries.select(F.col(query).alias("t_")).distinct().withColumn("form_", F.explode(forms)).withColumnRenamed("t_", "q_")
    found = a.join(b, "form_").select("t_", "q_").distinct().withColumn("distance", F.levenshtein("t_", "q_", radius))
    return found.filter("distance >= 0").select(F.col("q_").alias("query"), F.col("t_").alias("term"), "distance")


def _deletions(s: Column, radius: int) -> Column:
    """The text with up to ``radius`` characters left out."""
    forms = F.array(s)
    for _ in range(radius):
        shorter = F.flatten(
            F.transform(forms, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.left(t, i - 1), F.substring(t, i + 1, F.length(t)))))
        )
        forms = F.array_distinct(F.concat(forms, shorter))
    return forms


#: Query vectors that go to the tasks at a time.
BLOCK = 2_048


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """(query, key, cosine, rank): the ``k`` rows of ``vectors`` most alike to each row of ``queries``, other than itself, by
    rounded cosine and then by key, a whole number. Both tables have a key and a vector of one length.

    The queries go to all rows a block of bounded size at a time. A task keeps k rows a query, and these alone are shuffled.
    Null vectors and those of nought are alike to none.
    """
    rows, parts, held = vectors.select(key, F.col(vector).cast("array<double>").alias(vector)), [], []
    for row in queries.select(key, F.col(vector).cast("array<double>").alias(vector)).filter(F.col(vector).isNotNull()).toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            parts.append(_nearest_block(rows, held, key, k, digits))
            held = []
    if held or not parts:
        parts.append(_nearest_block(rows, held, key, k, digits))
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), F.asc(key))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _nearest_block(rows: DataFrame, block: list, key: str, k: int, digits: int) -> DataFrame:
    names = np.array([r[0] for r in block], np.int64)
    asked = np.array([r[1] for r in block], float) if block else np.zeros((0, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        asked = asked / np.linalg.norm(asked, axis=1, keepdims=True)
    shared = rows.sparkSession.sparkContext.broadcast((names, asked))

    def best(keys: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first k of each column by score and key."""
        order = np.argsort(keys, axis=0, kind="stable")
        keys, scores = np.take_along_axis(keys, order, 0), np.take_along_axis(scores, order, 0)
        order = np.argsort(-scores, axis=0, kind="stable")[:k]
        return np.take_along_axis(keys, order, 0), np.take_along_axis(scores, order, 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        keys, scores = np.zeros((0, len(names)), np.int64), np.zeros((0, len(names)))
        for batch in batches:
            whole = batch.filter(batch.column(1).is_valid()) if len(names) else batch.slice(0, 0)
            for at in range(0, whole.num_rows, 1_024):
                part = whole.slice(at, 1_024)
                own = np.asarray(part.column(0), np.int64)[:, None]
                v = np.asarray(part.column(1).flatten(), float).reshape(part.num_rows, asked.shape[1])
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.round((v / np.linalg.norm(v, axis=1, keepdims=True)) @ asked.T, digits)
                score[np.isnan(score) | (own == names[None, :])] = -np.inf
                new = best(np.broadcast_to(own, score.shape), score)
                keys, scores = best(np.concatenate((keys, new[0])), np.concatenate((scores, new[1])))
        good = scores > -np.inf
        query = np.broadcast_to(names[None, :], scores.shape)[good]
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(keys[good]), pa.array(scores[good])], names=["query", key, "cosine"])

    return rows.withColumn(key, F.col(key).cast("bigint")).mapInArrow(work, f"query long, {key} long, cosine double")
