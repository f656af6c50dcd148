"""Near copies by shingle similarity against brute force over all pairs."""

import random
import re

import corpus_pipeline as P
import loomstone.llm.near_copies as N
from tests.llm.test_near_duplicates import near, plain_components, plain_fingerprint


def plain_shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def alike(a, b):
    return a == b or (a and b and len(a & b) / len(a | b) >= 0.8)


def made():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("aeiourstln", k=5)) for _ in range(600)]
    texts = [None, "", " \t", "one", "One", "two words", "a b c d", "a b c d e", "A b c  d e f"]
    for _ in range(30):
        base = rng.choices(vocab, k=rng.randrange(20, 300))
        texts.append(" ".join(base))
        for share in (0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05):
            edited = [rng.choice(vocab) if rng.random() < share else w for w in base]
            texts.append(" ".join(edited) + (" tail" if share else "  "))
    return texts


def test_components_are_those_of_all_similar_pairs(spark):
    texts = made()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [plain_shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    want = plain_components(range(len(texts)), pairs)
    assert {r.doc_id: r.component for r in N.near_copies(docs).collect()} == want
    fps = [plain_fingerprint(t) for t in texts]
    assert any(sets[i] != sets[j] and (fps[i] ^ fps[j]).bit_count() > 3 for i, j in pairs)
    kept = P.simhash(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert N.near_copies(docs.limit(0)).count() == 0


def test_pipeline_drops_a_copy_with_many_bits_changed(spark):
    texts = made()
    sets, fps = [plain_shingles(t) for t in texts], [plain_fingerprint(t) for t in texts]
    i, j = next((i, j) for j in range(len(texts)) for i in range(j) if alike(sets[i], sets[j]) and not near([fps[i], fps[j]]))
    docs = spark.createDataFrame([(1, texts[i]), (2, texts[j])], "doc_id long, text string")
    assert [r.doc_id for r in P.simhash(spark, docs, "").collect()] == [1]


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words are here"), (7, "A b c d"), (9, "x y z"), (None, "x y z"), (None, None), (None, ""), (None, "all alone")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, id_ int")
    kept = sorted(((r.doc_id, r.text or "") for r in N.drop_near_copies(docs).collect()), key=str)
    assert kept == sorted([(1, "a b c d"), (1, "other words are here"), (9, "x y z"), (None, ""), (None, "all alone")], key=str)
    assert N.drop_near_copies(docs).columns == docs.columns and N.drop_near_copies(docs.limit(0)).count() == 0
