"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

Document counts of hashed n-grams by label come from all labelled training rows, as one distributed aggregation whose
result has a row per feature. Their smoothed log-count ratios scale the features; those whose ratio stands out from chance
are kept, and a logistic regression is fitted on them over a bounded sample of the training rows. The model is an array
of a fixed size, sent to the tasks that score whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.arrays import mix, slices
from loomstone.llm.common import fresh, quoted, with_body

GRAMS = (3, 4, 5)
BITS = 18
#: The regression is fitted on at most so many training rows, those whose ids have the least hashes.
FIT_ROWS = 8_000
#: The model's size: it has the features whose ratio stands out from chance by at least so many standard deviations, and of
#: them at most so many, those that do most. Counts are of all features.
STANDS_OUT, MOST_FEATURES = 5.0, 8_192
THRESHOLD = 0.3
#: Bytes of text whose n-grams are held at a time: their arrays take some eighty times as much.
PART_BYTES = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: the checksum of the id as text leaves 2 when divided by four."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all n-grams of all texts, repeats included; A-Z in lower case, null as empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    sizes = np.asarray(pc.utf8_length(texts), np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    whose, features = [], []
    state = np.zeros(len(points), np.uint64)
    for k in range(max(GRAMS)):
        n = len(points) - k
        if n <= 0:
            break
        state = state[:n] * np.uint64(0x9E3779B97F4A7C15) + points[k:] + np.uint64(1)
        if k + 1 in GRAMS:
            inside = left[:n] > k
            features.append((mix(state) >> np.uint64(64 - BITS)).astype(np.int32)[inside])
            whose.append(text[:n][inside])
    if not features:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(whose), np.concatenate(features)


def presence(column: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the n-grams with ``wanted`` true that each text has, each once, by text and feature."""
    whose, features = grams(column)
    kept = np.flatnonzero(wanted[features])
    both = np.unique(whose[kept].astype(np.int64) << BITS | features[kept])
    return both >> BITS, both & ((1 << BITS) - 1)


def count_presence(column: pa.Array, label: np.ndarray, have: np.ndarray) -> None:
    """Add one to ``have[label, feature]`` for each feature that a text has.

    Without a sort: of the places of one feature in a text, the one that was noted last counts.
    """
    whose, features = grams(column)
    order = np.argsort(whose, kind="stable")
    features, bounds = features[order], np.searchsorted(whose[order], np.arange(len(label) + 1))
    noted = np.zeros(1 << BITS, np.int32)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        own, place = features[a:b], np.arange(b - a, dtype=np.int32)
        noted[own] = place
        have[label[k], own[noted[own] == place]] += 1


@dataclass
class Model:
    """``weight`` of each feature, nought where it is not used, and the bias."""

    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        text, feature = presence(column, self.weight != 0)
        total = np.bincount(text, self.weight[feature], len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many texts of either label each feature is, and how many texts there are."""

    def work(batches):
        have = np.zeros((2, 1 << BITS), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                label = np.asarray(part.column("label"), np.int64)
                count_presence(part.column("text"), label, have)
                texts += np.bincount(label, minlength=2)
        at = np.flatnonzero(have.any(0))
        out = [np.append(at, -1), np.append(have[0][at], texts[0]), np.append(have[1][at], texts[1])]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["feature", "clean", "toxic"])

    found = rows.mapInArrow(work, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    table = found.toArrow()
    at, clean, toxic = (np.asarray(table[c], np.int64) for c in ("feature", "c", "t"))
    n = {int(a): (int(c), int(t)) for a, c, t in zip(at[at < 0], clean[at < 0], toxic[at < 0], strict=True)}.get(-1, (0, 0))
    counts = np.zeros((2, 1 << BITS))
    counts[0][at[at >= 0]], counts[1][at[at >= 0]] = clean[at >= 0], toxic[at >= 0]
    return counts[0], counts[1], *n


def ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The log-count ratio of each feature with one added to each count, and how far it stands out from chance: the root of
    the likelihood-ratio statistic of the feature's presence against the label."""
    p, q = (toxic + 1) / (n_toxic + 2), (clean + 1) / (n_clean + 2)
    seen, n = clean + toxic, n_clean + n_toxic

    def part(count: np.ndarray, row: np.ndarray, column: int) -> np.ndarray:
        expected = np.maximum(row * column / n, 1e-12)
        return count * np.log(np.maximum(count, 1e-12) / expected)

    far = part(toxic, seen, n_toxic) + part(clean, seen, n_clean)
    far += part(n_toxic - toxic, n - seen, n_toxic) + part(n_clean - clean, n - seen, n_clean)
    return np.log(p) - np.log(q), np.sqrt(np.maximum(2 * far, 0))


def _regress(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, labels: np.ndarray, n_cols: int) -> tuple[np.ndarray, float]:
    """Logistic regression with a square penalty, by Adam on all rows; deterministic."""
    n = len(labels)
    w, b = np.zeros(n_cols), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    first, second, rate, penalty = np.zeros(n_cols + 1), np.zeros(n_cols + 1), 0.05, 0.05
    for step in range(1, 301):
        z = np.bincount(rows, values * w[cols], n) + b
        slip = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(np.bincount(cols, values * slip[rows], n_cols) / n + penalty * w / max(n, 1) ** 0.5, slip.mean())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


TIE = ("o", "h", "n", "label")


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """(o, h, n, text, label) of at least ``most`` rows (id, text, label), or all of fewer: those with the least hash ``o`` of
    their id, found without the texts; more only where rows share the last id. ``_first`` then takes exactly ``most``."""
    o = F.xxhash64(F.col("id"), F.lit("fit")).alias("o")
    last = rows.select(o).orderBy("o").limit(most).agg(F.max("o").alias("o")).first().o
    kept = rows.withColumn("o", o).filter(F.col("o") <= F.lit(last).cast("bigint"))
    return kept.select("o", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"), "text", "label")


def _first(sample: DataFrame, most: int) -> DataFrame:
    """``most`` rows of a sample: the least by the hashes of id and text; rows that agree in these are alike."""
    return sample.orderBy(*TIE).limit(most).drop("o", "h", "n")


def train(rows: DataFrame, fit_rows: int = FIT_ROWS, stands_out: float = STANDS_OUT, most_features: int = MOST_FEATURES) -> Model:
    """A model from (id, text, label): counts over all rows, the regression over at most ``fit_rows`` of them, on the features
    that stand out from chance by ``stands_out`` standard deviations, of which the model holds at most ``most_features``.

    Without a row of either label every score is the share of toxic rows (a half where there are none).
    """
    clean, toxic, n_clean, n_toxic = _class_counts(rows)
    if not n_clean or not n_toxic:
        share = (n_toxic + 1) / (n_clean + n_toxic + 2)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    ratio, far = ratios(clean, toxic, n_clean, n_toxic)
    ranked = np.argsort(-far, kind="stable")[:most_features]
    kept = np.sort(ranked[far[ranked] >= stands_out])
    scale = np.zeros(1 << BITS)
    scale[kept] = ratio[kept]
    wanted = np.zeros(1 << BITS, bool)
    wanted[kept] = True
    place = np.cumsum(wanted) - 1

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                text, feature = presence(part.column("text"), wanted)
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place[feature].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in TIE], lists], names=[*TIE, "features"])

    found = _sample(rows, fit_rows).mapInArrow(work, "o long, h long, n int, label int, features array<int>")
    table = _first(found, fit_rows).toArrow()
    labels = np.asarray(table["label"], np.float64)
    lists = table["features"].combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    at = np.repeat(np.arange(len(labels), dtype=np.int32), sizes)
    cols = np.asarray(lists.flatten() if not isinstance(lists, pa.ChunkedArray) else pc.list_flatten(lists), np.int32)
    weight = np.zeros(1 << BITS)
    fitted, bias = _regress(at, cols, scale[kept][cols], labels, len(kept))
    weight[kept] = fitted * scale[kept]
    return Model(weight, bias)


def add_scores(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of label 1 of each whole text (null as empty); rows do not move."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(out)
    names = kept.columns
    rows, body = with_body(kept, text)

    def work(batches):
        for batch in batches:
            for part in slices(batch, body, PART_BYTES):
                scores = pa.array(shared.value.scores(part.column(body)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], scores], names=[*names, out])

    return rows.mapInArrow(work, T.StructType([*kept.schema, T.StructField(out, T.DoubleType())]))


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(id, text, label) of the training rows: those with a label of 0 or 1 that are not held out."""
    marks = labels.select(quoted(doc_id).alias("id"), quoted(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    rows = docs.select(quoted(doc_id).alias("doc"), quoted(text).cast("string").alias("text")).filter(~held_out(F.col("doc")))
    return rows.join(marks.hint("shuffle_hash"), F.col("doc") == F.col("id")).select("id", F.coalesce("text", F.lit("")).alias("text"), "label")


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``held_out`` (boolean), ``score`` (double, 0 to 1) and ``predicted`` (int, 1 from 0.3 upwards).

    Learnt from the rows that ``labels`` marks and that are not held out; only texts are looked at. Labels of other
    rows, null labels and labels other than 0 and 1 teach nothing; an id labelled twice counts twice. A null text
    scores as an empty one, a null id is not held out, repeated rows score alike, and an empty table stays empty.
    Columns of ``docs`` of those three names give way.
    """
    model = train(labelled(docs, labels, text, doc_id))
    rows = add_scores(docs.drop("held_out", "predicted"), model, text)
    kept = [quoted(c) for c in rows.columns if c != "score"]
    return rows.select(*kept, held_out(quoted(doc_id)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    score, = fresh(docs, "score_")
    scored = add_scores(docs, train(labelled(docs, labels, text, doc_id)), text, score)
    return scored.filter(F.col(score) < THRESHOLD).select(*[quoted(c) for c in docs.columns])
