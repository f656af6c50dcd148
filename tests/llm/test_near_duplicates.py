"""SimHash near-dedup and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import loomstone.llm.simhash as S
from loomstone.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_components(values, links):
    least = {v: v for v in values}

    def root(v):
        while least[v] != v:
            v = least[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


def near(fps):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]


def test_fingerprints(spark):
    texts = [None, "", " \t", "one", "One TWO", "a b c", "A b\x0bc  d", "é ñ ß è", "x " * 500, "a\x1cb c d e f g", "w" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.fp for r in S.fingerprints(docs, "text", "doc_id").collect()}
    assert got == {i: signed(plain_fingerprint(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("crowd", [0, 2, 64])
def test_links_have_the_components_of_all_near_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(12):
            flips = rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5]))
            fps.add(signed(center ^ sum(1 << b for b in flips)))
    # Pairs of exactly three differences in every way over the segments, chains of them, and the ring's seam.
    for segments in ((0, 1, 2), (0, 0, 0), (1, 1, 3), (3, 0, 1), (2, 2, 3)):
        base = rng.getrandbits(64)
        fps |= {signed(base), signed(base ^ sum(1 << (16 * s + 5 + k) for k, s in enumerate(segments)))}
    fps |= {0, 7, 7 << 61 & (2**63 - 1), -1, signed((2**64 - 1) ^ 0b111)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    made = S.links(df)
    pairs = [tuple(r) for r in made.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in pairs)
    got = {r.id: r.component for r in components(df.select(F.col("fp").alias("id")), made).collect()}
    assert got == plain_components(fps, near(fps))


def test_components_of_long_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(2000, 2000), (2001, 2002), (2002, 2001)]
    ids = sorted({v for e in edges for v in e} | {5000})
    v = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.component for r in components(v, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == plain_components(ids, edges)
    none = spark.createDataFrame([], "src long, dst long")
    assert all(r.id == r.component for r in components(v, none).collect())


def test_near_duplicates_end_to_end(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    base = " ".join(rng.choices(words, k=300))
    rows = [(50 + i, base) for i in range(3)] + [(40, base + " end"), (7, "unlike all others"), (3, ""), (2, None), (99, "unlike  all\tOTHERS")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component int")
    got = {r.doc_id: r.component for r in S.near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    want = plain_components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert got == want and got[99] == 7 and got[3] == 2
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_kept_apart(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "other words here")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, None)], key=str)


def test_bits_are_set_by_more_than_half():
    column = __import__("pyarrow").array(["a b c d"])
    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d")]
    assert S._fingerprints(column, 3)[0] == np.uint64(h[0] & h[1])


def test_no_join_of_fingerprints_or_links_goes_through_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    plans = lambda: {e.executionId(): e.physicalPlanDescription() for e in map(store.executionsList().apply, range(store.executionsList().size()))}
    known = set(plans())
    docs = spark.createDataFrame([(i, f"a b c {i % 7}") for i in range(40)], "doc_id long, text string")
    assert len(S.near_duplicates(docs).collect()) == 40
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = [p for i, p in plans().items() if i not in known]
    assert new and not any("BroadcastExchange" in p for p in new)
