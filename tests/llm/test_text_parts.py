"""Passes through Arrow hold a text once, and small parts of it at a time."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from loomstone.llm import bpe
from loomstone.llm import toxicity as X
from loomstone.llm.arrays import slices


def test_ngrams_are_held_in_small_parts():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(400)) for _ in range(1_000)]
    batch = pa.record_batch({"text": pa.array(texts)})
    have, model = np.zeros((2, 1 << X.BITS), np.int64), X.Model(np.ones(1 << X.BITS), 0.0)
    tracemalloc.start()
    try:
        for part in slices(batch, "text", X.PART_BYTES):
            X.count_presence(part.column("text"), np.zeros(part.num_rows, np.int64), have)
            model.scores(part.column("text"))
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()


def test_texts_go_through_arrow_once(spark, monkeypatch):
    kind = type(spark.range(0))
    sent, through = [], kind.mapInArrow

    def noted(self, *args, **kwargs):
        sent.append(self.columns)
        return through(self, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    docs = spark.createDataFrame([(1, "so it goes", 7), (2, None, 8), (3, "", 9)], "doc_id long, Text string, n int")
    model = X.Model(np.linspace(-1, 1, 1 << X.BITS), 0.5)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    made = [(X.add_scores(docs, model), "score"), (bpe.encode(docs, vocabulary), "ids")]
    assert sent == [docs.columns, docs.columns]
    for out, name in made:
        assert out.columns == [*docs.columns, name]
        # Another place or another type of the text changes nothing.
        for other in (docs.select("n", "Text", "doc_id"), docs.withColumn("Text", F.col("text").cast("binary"))):
            again = (lambda d: X.add_scores(d, model) if name == "score" else bpe.encode(d, vocabulary))(other)
            assert again.columns == [*other.columns, name] and again.schema["Text"] == other.schema["Text"]
            assert {r.doc_id: r[name] for r in again.collect()} == {r.doc_id: r[name] for r in out.collect()}
    assert out.schema["Text"].dataType == T.StringType()
