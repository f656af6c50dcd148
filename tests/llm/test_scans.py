"""Decontamination, license scans and toxicity against plain versions and held-out labels."""

import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import loomstone.llm.decontaminate as D
import loomstone.llm.license_scan as L
import loomstone.llm.toxicity as T


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain_contamination(text, items):
    doc, hit, found = words(text), set(), set()
    for i, item in items:
        w = words(item)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == w[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(i)
    return len(doc), len(hit), sorted(found)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "a", "of", "Wörd", "x1", *("".join(rng.choices("abcdé", k=3)) for _ in range(30))]
    phrase = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, phrase(n)) for i, n in enumerate([12, 30, 10, 9, 3, 1, 5, 50])]
    items += [(20, None), (21, ""), (22, "..."), (23, items[1][1]), (24, " ".join(["same"] * 15)), (25, items[0][1].upper())]
    docs = [phrase(rng.randrange(0, 80)) for _ in range(25)] + [None, "", "same " * 30, "The; " * 3]
    for _, item in items[:8]:
        cut = item.split()
        docs.append(phrase(7) + ", " + " ".join(cut[: max(1, len(cut) - 2)]) + "!\n" + phrase(5))
        docs.append(item)
    docs.append((phrase(3000) + " " + items[1][1] + " ") * 3)
    return list(enumerate(docs)), items


@pytest.mark.parametrize("few", [0, 500_000])
@pytest.mark.parametrize("bits", [7, 26])
def test_windows_agree_with_plain_search(spark, monkeypatch, few, bits):
    monkeypatch.setattr(D, "BROADCAST_ROWS", few)
    monkeypatch.setattr(D, "BITMAP", bits)
    docs, items = corpus(1)
    found = D.contamination(
        spark.createDataFrame([(*d, 9, 9) for d in docs], "doc_id long, text string, n_words int, id int"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}
    assert got == {i: plain_contamination(t, items) for i, t in docs}


@pytest.mark.parametrize("few", [0, 500_000])
def test_repeated_and_null_ids_and_ids_of_text(spark, monkeypatch, few):
    monkeypatch.setattr(D, "BROADCAST_ROWS", few)
    rows = [(1, "alpha beta"), (1, "alpha beta"), (None, "a b c"), (None, "alpha x y z q"), (2, None), (1, "other")]
    items = [("x", "alpha"), ("x", "y z"), (None, "a b"), ("w", "ALPHA"), ("v", None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    found = D.contamination(docs, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.begins, r.ends) for r in found), key=str) == sorted(
        [
            (1, 2, 1, ["w", "x"], [0], [1]),
            (1, 2, 1, ["w", "x"], [0], [1]),
            (None, 3, 2, [None], [0], [2]),
            (None, 5, 3, ["w", "x"], [0, 2], [1, 4]),
            (2, 0, 0, [], [], []),
            (1, 1, 0, [], [], []),
        ],
        key=str,
    )
    kept = D.drop_contaminated(docs.withColumn("T1_", F.lit(5)), bench)
    assert kept.columns == ["doc_id", "text", "T1_"] and sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "other", 5), (2, None, 5)], key=str)


def test_decontamination_of_nothing_and_by_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in D.contamination(docs, none).orderBy("doc_id").collect()] == [(0, 0), (3, 0)]
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert D.contamination(docs.limit(0), items).count() == 0
    kept = D.drop_contaminated(docs.withColumn("id_", F.lit(1)), items)
    assert kept.columns == ["doc_id", "text", "id_"] and [r.doc_id for r in kept.collect()] == [None]


def test_bands_find_what_a_full_search_finds():
    rng = random.Random(2)
    noise = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    texts = ["", None, "four words are short"]
    for name, t in L.TEMPLATES.items():
        w = t.split()
        texts += [t, f"{noise(rng.randrange(0, 90))} {t.upper()} {noise(40)}", noise(50)]
        if len(w) > 30:
            texts += [" ".join(w[: len(w) * 9 // 10]), " ".join(w[: len(w) // 2])]
    column, known = pa.array(texts, pa.string()), L.Templates(L.TEMPLATES)
    found = L.find_templates(column, known)
    assert found == L.find_templates(column, known, banded=False)
    by_text = {}
    for t, owner, share, _ in found:
        by_text.setdefault(t, {})[known.names[owner]] = share
    for t, text in enumerate(texts):
        for name, template in L.TEMPLATES.items():
            if text and re.sub(r"\W+", " ", template).lower().strip() in re.sub(r"\W+", " ", text).lower():
                assert by_text[t][name] == 1.0
    assert not {0, 1, 2} & set(by_text)


def test_license_frames(spark):
    mit = L.TEMPLATES["MIT"]
    docs = spark.createDataFrame([(1, f"x y {mit}", 0), (1, f"x y {mit}", 0), (None, None, 0)], "doc_id long, text string, licenses int")
    got = sorted(((r.doc_id, [x.name for x in r.licenses]) for r in L.scan_licenses(docs).collect()), key=str)
    assert got == [(1, ["MIT"]), (1, ["MIT"]), (None, [])]
    assert L.scan_licenses(docs.limit(0)).count() == 0
    assert L.scan_licenses(docs, {"short": "a b c"}).filter(F.size("licenses") > 0).count() == 0


def labelled_corpus(n):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("aeiourstln", k=rng.randrange(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = rng.choices(vocab, k=rng.randrange(5, 60))
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["grimsplat", "VORKNAST", "bluzzdarg"]))
        docs.append((i, " ".join(text), "src", 1.5))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled_corpus(900)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, score double")
    found = T.score_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert found.columns == ["doc_id", "text", "source", "held_out", "score", "predicted"]
    rows, truth = found.collect(), dict(labels)
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    docs, labels = labelled_corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, score double")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    score = lambda ls, docs=d: {r.doc_id: r.score for r in T.score_toxicity(docs, spark.createDataFrame(ls, "doc_id long, toxic int")).collect()}
    assert score(labels) == score(flipped) == score(labels, d.withColumn("source", F.lit("toxic")))


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, ""), (3, "word " * 20_000)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)], [(1, None), (2, 5)], [(1, 0), (2, 1), (3, 1), (3, 0)]):
        rows = T.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if not r.text}) == 1
    assert T.score_toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_dropping_keeps_all_columns(spark):
    docs, labels = labelled_corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, score double").withColumn("score_", F.lit(1))
    kept = T.drop_toxic(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows, truth = kept.collect(), dict(labels)
    assert kept.columns == d.columns and all(r.score == 1.5 for r in rows)
    assert sum(truth[r.doc_id] for r in rows) <= 3 and len(rows) > 280


def plain_features(text):
    """The distinct hashed n-grams of a text, by whole numbers."""
    points = [ord(c) + 32 * ("A" <= c <= "Z") for c in text or ""]
    out, most = set(), 2**64
    for n in (3, 4, 5):
        for k in range(len(points) - n + 1):
            x = 0
            for p in points[k : k + n]:
                x = (x * 0x9E3779B97F4A7C15 + p + 1) % most
            x ^= x >> 30
            x = x * 0xBF58476D1CE4E5B9 % most
            x ^= x >> 27
            x = x * 0x94D049BB133111EB % most
            out.add((x ^ x >> 31) >> (64 - T.BITS))
    return out


def test_counts_ratios_and_scores_against_brute_force(spark):
    docs, labels = labelled_corpus(260)
    docs[3] = (3, None, "", 0.0)
    rows = T.labelled(spark.createDataFrame(docs, "doc_id long, text string, s string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    taught = {i: t for i, t, *_ in docs if zlib.crc32(str(i).encode()) % 4 != 2}
    have = {i: plain_features(t) for i, t in taught.items()}
    clean, toxic, n_clean, n_toxic = T._class_counts(rows)
    for label, counts in ((0, clean), (1, toxic)):
        want = {}
        for i, own in have.items():
            for f in own if truth[i] == label else ():
                want[f] = want.get(f, 0) + 1
        assert {int(f): int(counts[f]) for f in counts.nonzero()[0]} == want
    assert (n_clean, n_toxic) == (sum(not truth[i] for i in taught), sum(truth[i] for i in taught))
    ratio, far = T.ratios(clean, toxic, n_clean, n_toxic)
    for f in sorted({f for own in have.values() for f in own})[::97]:
        a, b = toxic[f], clean[f]
        assert ratio[f] == pytest.approx(math.log((a + 1) / (n_toxic + 2)) - math.log((b + 1) / (n_clean + 2)))
        cells = [(a, a + b, n_toxic), (b, a + b, n_clean), (n_toxic - a, len(taught) - a - b, n_toxic), (n_clean - b, len(taught) - a - b, n_clean)]
        assert far[f] == pytest.approx(math.sqrt(max(0, 2 * sum(c * math.log(c * len(taught) / (r * n)) for c, r, n in cells if c))), abs=1e-4)
    model = T.train(rows, 100)
    assert set(model.weight.nonzero()[0]) <= {f for f in range(1 << T.BITS) if far[f] >= T.STANDS_OUT}
    for text in ("", "grimsplat here", docs[0][1]):
        z = model.bias + sum(model.weight[f] for f in plain_features(text))
        assert model.scores(pa.array([text]))[0] == pytest.approx(1 / (1 + math.exp(-z)))


def test_the_sample_is_exact_with_repeated_ids_and_rows(spark):
    rows = [(7, "same", 0)] * 30 + [(7, f"text {k}", k % 2) for k in range(30)] + [(k, "x", 1) for k in range(100, 130)]
    df = spark.createDataFrame(rows, "id long, text string, label int").repartition(5)
    for most in (1, 10, 45, 89, 90, 500):
        got = sorted(map(tuple, T._first(T._sample(df, most), most).collect()))
        assert len(got) == min(most, 90) and got == sorted(map(tuple, T._first(T._sample(df.repartition(3), most), most).collect()))
    assert T._first(T._sample(df.limit(0), 5), 5).count() == 0


def test_counting_agrees_with_sets():
    texts = ["abcabc", None, "ABCabd", "é日本語é日本語", "ab"]
    import numpy as np

    have = np.zeros((2, 1 << T.BITS), np.int64)
    T.count_presence(pa.array(texts, pa.string()), np.array([0, 0, 1, 1, 0]), have)
    text, feature = T.presence(pa.array(texts, pa.string()), np.ones(1 << T.BITS, bool))
    for label in (0, 1):
        want = np.bincount(feature[np.isin(text, [i for i, y in enumerate([0, 0, 1, 1, 0]) if y == label])], minlength=1 << T.BITS)
        assert (have[label] == want).all()
