"""Line dedup, Merkle fingerprints and the order of documents, against plain versions."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstone.llm.line_dedup import dedup_lines
from loomstone.llm.merkle import fingerprint, with_next

WS = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def plain_dedup(texts, least, chars=1):
    keys = [[ascii_lower(x.strip(WS)) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(k for ks in keys for k in set(ks))
    out = []
    for t, ks in zip(texts, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks, strict=True) if not (len(k) >= chars and seen[k] >= least)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


TEXTS = ["a\nB \nc", "A\n\tb\n\n", "Ä\nä\na", None, "", "\n", "b", "long " * 5000 + "\nA", "a\na\na", " a"]


@pytest.mark.parametrize("least,chars", [(2, 1), (3, 1), (2, 2), (100, 1), (1, 1)])
def test_dedup_agrees_with_plain_version(spark, least, chars):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs, least, chars).collect()}
    assert [got[i] for i in range(len(TEXTS))] == plain_dedup(TEXTS, least, chars)


def test_dedup_with_repeated_and_null_ids_and_clashing_columns(spark):
    texts = ["x\ny", "x\ny", "x\nz", "z"]
    rows = [(1, t, 5, 6, 7) for t in texts[:2]] + [(None, t, 5, 6, 7) for t in texts[2:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad_ int, lines_ int, t1_ int")
    out = dedup_lines(docs, 2)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert Counter((r.doc_id, r.text, r.bad_) for r in out.collect()) == Counter([(1, "y", 5), (1, "y", 5), (None, "z", 5), (None, "z", 5)])


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "own\nline")] * 10 + [(k, "shared") for k in range(2, 12)], "doc_id long, text string")
    found = Counter((r.text, r.n_dropped) for r in dedup_lines(docs, 10).collect())
    assert found == Counter({("own\nline", 0): 10, ("", 1): 10})


def test_dedup_beyond_the_broadcast_bound(spark, monkeypatch):
    import loomstone.llm.line_dedup as module

    docs = spark.createDataFrame([(i, f"hot\nwarm{i % 5}\nown{i}") for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, dedup_lines(docs, 4).collect()))
    monkeypatch.setattr(module, "BROADCAST_KEYS", 2)
    monkeypatch.setattr(module, "HOT_DOCS", 30)
    assert sorted(map(tuple, dedup_lines(docs, 4).collect())) == want
    assert all(r[1].startswith("own") for r in want)


def test_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(docs).count() == 0


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
def test_with_next_agrees_with_plain_order(spark, buckets):
    ids = [5, 9, -3, 12, 7, 100, 55, 8, 41, 2]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.nxt for r in with_next(docs, "doc_id", "text", "nxt", buckets).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_with_next_of_one_row_none_and_ties(spark):
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert with_next(one, "doc_id", "text", "nxt").first().nxt == "a"
    assert with_next(one.limit(0), "doc_id", "text", "nxt").count() == 0
    ties = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "doc_id long, text string")
    found = with_next(ties, "doc_id", "text", "nxt").collect()
    assert len(found) == 4 and {r.nxt for r in found} == {"a", "b", "c", "d"}
    assert next(r.nxt for r in found if r.doc_id is None) == "d"


def test_fingerprint_is_native(spark):
    plan = spark.range(1).select(fingerprint(F.lit("x")))._jdf.queryExecution().toString()
    assert "Python" not in plan
