"""Terms are searched in one pass over each text; nothing but counts leaves its row."""

import random

import pytest

import __spark_entry__ as E
from loomstone.operators import lexicon

TERMS = [["the", "he", "th", "ab", "bab"], ["a", "aa", "aaaa"], ["\U0001f600", "a\U0001f600a"], ["-", "--", "\n", "\\E", "^$.*["], ["a" * 2100, "b"]]


def plain(text, terms):
    return sorted((i, i + len(w), w) for w in terms for i in range(len(text or "")) if text.startswith(w, i))


def texts():
    rnd = random.Random(5)
    some = [None, "", "the", "-the--", "\\E^$.*[", "a" * 4500, "a\U0001f600" * 2500, "\u00e9" * 2047 + "the" + "x" * 2045 + "thethe"]
    return some + ["".join(rnd.choice("ab\U0001f600\u00e9\n-") for _ in range(n)) for n in (5, 2047, 2048, 2049, 5000)]


def test_a_text_is_searched_once_and_stays_in_its_row(spark):
    plan = E.queries()["q_multi_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1 and plan.count("reduce(split(") == 1


def test_rows_that_share_a_key_keep_their_own_hits(spark):
    df = spark.createDataFrame([(1, "the"), (1, "xthe"), (None, "he"), (None, "the")], "i int, t string")
    got = [(r.i, r.t, [tuple(h) for h in r.found]) for r in lexicon.multi_search(df, "t", "i", ["the"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "the", [(0, 3, "the")]), (1, "xthe", [(1, 4, "the")]), (None, "he", []), (None, "the", [(0, 3, "the")])], key=str)


@pytest.mark.parametrize("terms", TERMS, ids=range(len(TERMS)))
@pytest.mark.parametrize("few, heads, broadcast", [(512, 256, 10**6), (0, 256, 10**6), (0, 0, 0)])
def test_all_ways_find_all_places(spark, monkeypatch, terms, few, heads, broadcast):
    monkeypatch.setattr(lexicon, "MOST_TERMS", few)
    monkeypatch.setattr(lexicon, "MOST_HEADS", heads)
    monkeypatch.setattr(lexicon, "MOST_BROADCAST", broadcast)
    rows = list(enumerate(texts()))
    found = lexicon.multi_search(spark.createDataFrame(rows, "i int, t string"), "t", "i", terms)
    assert {r.i: [tuple(h) for h in r.found] for r in found.collect()} == {i: plain(t, terms) for i, t in rows}
