"""The Merkle tree: parents follow from their children, likeness is that of the clauses, and every edit is located."""

import re
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from loomstone.llm.merkle import add_fingerprints, differing_paragraphs, fingerprint, likeness


def digest(text):
    return md5(text.encode()).hexdigest()


def marks(paragraph):
    return [digest(c)[:8] for c in re.sub(r"([.!?,;:|&$%*#][ \t]+)", "\\1\x01", paragraph).split("\x01")]


LONG = "\n".join(f"Line {i}. It says, again; that {i % 7} is so." + "\n" * (i % 5 == 0) for i in range(3000))
TEXTS = ["One. Two, three\n\nfour\nfive; six", "", None, "a\x01b,\t c", "\n", "\n\n\n", "x" * 100_000, LONG, "é ñ. ß", "same\nsame\n\nsame"]


def test_parents_follow_from_children(spark):
    docs = spark.createDataFrame([(t, k, "x") for k, t in enumerate(TEXTS)], "text string, k int, fingerprint string")
    found = add_fingerprints(docs)
    assert sorted(found.columns) == sorted(docs.columns)
    for r in found.collect():
        top, rest = r.fingerprint.split(":")
        sections = [s.split("/") for s in rest.split(";")]
        assert top == digest("".join(d for d, _ in sections))
        for (d, paragraphs), text in zip(sections, (r.text or "").split("\n\n"), strict=True):
            own = [p.split(".") for p in paragraphs.split(",")]
            assert d == digest("".join(h for h, _ in own))
            assert [tuple(p) for p in own] == [(digest(p), "".join(marks(p))) for p in text.split("\n")]


def plain_likeness(a, b):
    a, b = a or "", b or ""
    x, y = ({m for s in t.split("\n\n") for p in s.split("\n") for m in marks(p)} for t in (a, b))
    if a == b:
        return 1.0
    return len(x & y) / (max(len(x), len(y)) + 1)


EDITS = [
    ("One. Two, three", "One. Two,\tthree", [(0, 0)]),
    ("a\nb. c\n\nd", "a\nb.  c\n\nd", [(0, 1)]),
    ("a\n\nb", "a\n\nb\nc\n\nd", [(1, 1), (2, 0)]),
    ("a\n\nb\nc", "a", [(1, 0), (1, 1)]),
    ("a. b. c. d", "c. b. a. d", [(0, 0)]),
    ("same, text", "same, text", []),
    (None, "", []),
    ("", "a", [(0, 0)]),
    (LONG, LONG.replace("Line 2999.", "Line 2998."), [(600, 3)]),
]


def test_every_edit_is_located_and_only_equal_texts_are_wholly_alike(spark):
    a, b = fingerprint(F.col("a")), fingerprint(F.col("b"))
    df = spark.createDataFrame([r[:2] for r in EDITS], "a string, b string").select("a", "b", a.alias("x"), b.alias("y"))
    found = df.select("a", "b", "x", differing_paragraphs(F.col("x"), F.col("y")).alias("d"), likeness(F.col("x"), F.col("y")).alias("like")).collect()
    for r, (p, q, places) in zip(found, EDITS, strict=True):
        if p != LONG:
            assert [tuple(x) for x in r.d] == places
        else:
            assert len(r.d) == 1
        assert r.like == pytest.approx(plain_likeness(p, q)) and (r.like == 1) == ((p or "") == (q or ""))
