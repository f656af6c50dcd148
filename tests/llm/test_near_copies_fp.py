"""The SimHash step of near copies: its candidates against brute force, and what it joins alone."""

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
import loomstone.llm.near_copies as N
from tests.llm.test_near_copies import alike, made, plain_shingles
from tests.llm.test_near_duplicates import near, plain_components


def test_near_copies_of_few_bits_are_found_by_fingerprint(spark, monkeypatch):
    texts = [" ".join(f"w{k * 7919 % 100_003}" for k in range(b * 1000, b * 1000 + 250)) for b in range(5)]
    texts += [t + " tail" for t in texts] + ["", "no copy of another", "nor is this one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys, fps, _ = N._signatures(pa.array(texts))
    pairs = near(sorted({int(f) for f in fps}))
    assert len(pairs) >= 5
    each = spark.createDataFrame([(int(k), int(f)) for k, f in zip(keys.view(np.int64), fps.view(np.int64), strict=True)], "key long, fp long")
    found = {tuple(r) for r in N._simhash_pairs(each).collect()}
    of = dict(zip(keys.view(np.int64).tolist(), fps.tolist(), strict=True))
    assert all(a > b and (of[a] ^ of[b]).bit_count() <= 3 for a, b in found)
    assert plain_components(of, found) == plain_components(of, [(a, b) for a in of for b in of if a > b and (of[a] ^ of[b]).bit_count() <= 3])

    # Neither bands nor rare shingles give a candidate: what is joined is joined by fingerprints.
    none = spark.createDataFrame([], "src long, dst long")
    monkeypatch.setattr(N, "_band_pairs", lambda members: none)
    monkeypatch.setattr(N, "_rare_pairs", lambda left, texts: none)
    assert sorted(r.doc_id for r in P.simhash(spark, docs, "").collect()) == [0, 1, 2, 3, 4, 10, 11, 12]


def test_fingerprints_that_are_near_do_not_join_texts_that_are_not(spark, monkeypatch):
    texts = made()[:60]
    sets = [plain_shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Every pair is a candidate, alike or not.
    every = lambda each: N.cut(each.crossJoin(each.select(N.F.col("key").alias("other"))).filter("key > other").select(N.F.col("key").alias("src"), N.F.col("other").alias("dst")))
    monkeypatch.setattr(N, "_simhash_pairs", every)
    want = plain_components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    assert {r.doc_id: r.component for r in N.near_copies(docs).collect()} == want
