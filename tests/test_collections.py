"""Array and map functions against Python's lists and dictionaries."""

import itertools
import math
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.functions import collections as C

CASES = {
    "keep": (lambda A: C.keep(A, 2), lambda a: a[:2]),
    "keep_right": (lambda A: C.keep(A, 2, True), lambda a: a[-2:]),
    "skip": (lambda A: C.skip(A, 2), lambda a: a[2:]),
    "skip_right": (lambda A: C.skip(A, 2, True), lambda a: a[:-2]),
    "excerpt": (lambda A: C.excerpt(A, 1, 4), lambda a: a[1:4]),
    "excerpt_beyond": (lambda A: C.excerpt(A, 3, 1), lambda a: []),
    "before": (lambda A: C.before(A, 2), lambda a: a[:2]),
    "upto": (lambda A: C.upto(A, 2), lambda a: a[:3]),
    "from": (lambda A: C.from_(A, 2), lambda a: a[2:]),
    "after": (lambda A: C.after(A, 2), lambda a: a[3:]),
    "where": (lambda A: C.where(A, lambda x: x > 2), lambda a: next((i for i, x in enumerate(a) if x > 2), None)),
    "seek": (lambda A: C.seek(A, lambda x: x > 2), lambda a: next((x for x in a if x > 2), None)),
    "keep_while": (lambda A: C.keep_while(A, lambda x: x < 3), lambda a: list(itertools.takewhile(lambda x: x < 3, a))),
    "skip_while": (lambda A: C.skip_while(A, lambda x: x < 3), lambda a: list(itertools.dropwhile(lambda x: x < 3, a))),
    "keep_while_right": (lambda A: C.keep_while(A, lambda x: x < 3, True), lambda a: list(itertools.takewhile(lambda x: x < 3, a[::-1]))[::-1]),
    "before_match": (lambda A: C.before_match(A, lambda x: x == 3), lambda a: a[: a.index(3)] if 3 in a else a[:-1]),
    "upto_match": (lambda A: C.upto_match(A, lambda x: x == 3), lambda a: a[: a.index(3) + 1] if 3 in a else a),
    "all": (lambda A: C.all_(A, lambda x: x >= 0), lambda a: True),
    "count": (lambda A: C.count(A, lambda x: x == 1), lambda a: a.count(1)),
    "unique": (lambda A: C.unique(A), lambda a: a[0] if len(a) == 1 else None),
    "occupied": (lambda A: C.occupied(A), lambda a: a or None),
    "subsumes": (lambda A: C.subsumes(A, F.array(F.lit(1), F.lit(2))), lambda a: any(a[i : i + 2] == [1, 2] for i in range(len(a)))),
    "weave": (lambda A: C.weave(A, C.skip(A, 1)), lambda a: [v for p in zip(a, a[1:]) for v in p]),
    "batched": (lambda A: C.batched(A, 3), lambda a: [a[i : i + 3] for i in range(0, len(a), 3)]),
    "slide": (lambda A: C.slide(A, 3), lambda a: [a[i : i + 3] for i in range(len(a) - 2)]),
    "runs": (lambda A: C.runs(A), lambda a: [list(g) for _, g in itertools.groupby(a)]),
    "trace": (lambda A: C.trace(A, F.lit(0), lambda s, x: s + x), lambda a: list(itertools.accumulate(a, initial=0))),
    "fold_right": (lambda A: C.fold(A, F.lit(0), lambda s, x: s * 2 + x, True), lambda a: sum(x * 2**i for i, x in enumerate(a))),
    "distinct": (lambda A: C.distinct(A), lambda a: list(dict.fromkeys(a))),
    "define": (lambda A: C.define(A, 1, F.lit(9)), lambda a: [9 if i == 1 else x for i, x in enumerate(a)]),
    "unwind": (lambda A: C.unwind(A, F.array(F.lit(7))), lambda a: a[::-1] + [7]),
    "intercalate": (lambda A: C.intercalate(C.batched(A, 2), F.array(F.lit(0))), lambda a: [x for i, v in enumerate(a) for x in ([0, v] if i and i % 2 == 0 else [v])]),
    "sort_by": (lambda A: C.sort_by(A, lambda x: x % 2), lambda a: sorted(a, key=lambda x: x % 2)),
    "sweep": (lambda A: C.sweep(A, lambda x: x > 1, lambda x: x * 10), lambda a: [x * 10 for x in a if x > 1]),
}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(arrays=st.lists(st.lists(st.integers(0, 4), max_size=8), min_size=25, max_size=40))
def test_arrays_agree_with_lists(spark, arrays):
    arrays = [*arrays, [], [3], [1, 2], [0] * 9]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    rows = df.select("i", *[f(F.col("a")).alias(n) for n, (f, _) in CASES.items()]).collect()
    for row in rows:
        for name, (_, want) in CASES.items():
            assert row[name] == want(arrays[row.i]), (name, arrays[row.i])


def test_pairs_and_parts(spark):
    A = F.col("a")
    df = spark.createDataFrame([([1, 2, 3], ["a", "b"])], "a array<int>, b array<string>")
    row = df.select(
        C.zip_(A, F.col("b")).alias("z"), C.snip(A, 1).alias("s"), C.span(A, lambda x: x < 2).alias("p"), C.snip_match(A, lambda x: x == 9).alias("none"),
        C.partition(A, lambda x: x > 1).alias("q"), C.indexed(A).alias("n"),
    ).first()
    assert [tuple(x) for x in row.z] == [(1, "a"), (2, "b")]
    assert tuple(row.s) == ([1], [2, 3]) == tuple(row.p) and row.none is None and tuple(row.q) == ([2, 3], [1])
    assert [tuple(x) for x in row.n] == [(0, 1), (1, 2), (2, 3)]


def test_null_arrays_and_elements(spark):
    A = F.col("a")
    df = spark.createDataFrame([(None,), ([None, 1, None],)], "a array<int>")
    got = df.select(C.keep(A, 1).alias("k"), C.sequence_all(A).alias("s"), C.where(A, lambda x: x == 1).alias("w"), C.runs(A).alias("r")).collect()
    assert tuple(got[0]) == (None, None, None, None)
    assert got[1].k == [None] and got[1].s is None and got[1].w == 1 and got[1].r == [[None], [1], [None]]


def test_maps(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4})], "x map<string,int>, y map<string,int>")
    x, y = F.col("x"), F.col("y")
    row = df.select(
        C.collate(x, y, lambda p, q: p * 10 + q).alias("c"), C.map_union(x, y).alias("u"), C.removed(x, F.lit("a")).alias("r"),
        C.upsert(x, F.lit("b"), lambda v: F.coalesce(v, F.lit(0)) + 5).alias("p"), C.upsert(x, F.lit("z"), lambda v: F.coalesce(v, F.lit(0)) + 5).alias("q"),
    ).first()
    assert row.c == {"a": 1, "b": 23, "c": 4} and row.u == {"a": 1, "b": 3, "c": 4} and row.r == {"b": 2}
    assert row.p == {"a": 1, "b": 7} and row.q == {"a": 1, "b": 2, "z": 5}
    multi = spark.createDataFrame([({"a": [1]},)], "m map<string,array<int>>").select(C.plus(F.col("m"), F.lit("a"), F.lit(0)), C.plus(F.col("m"), F.lit("b"), F.lit(9))).first()
    assert multi[0] == {"a": [0, 1]} and multi[1] == {"a": [1], "b": [9]}
    indexed = spark.createDataFrame([([5, 16, 25],)], "a array<int>").select(C.index_by(F.col("a"), lambda v: v % 10)).first()[0]
    assert indexed == {5: 25, 6: 16}


@pytest.mark.parametrize("n", [1, 3, 4])
def test_permutation_ranks(spark, n):
    A = F.col("a")
    orders = list(itertools.permutations(range(n)))
    df = spark.createDataFrame([(i, list(o)) for i, o in enumerate(orders)], "i int, a array<int>")
    assert all(r.i == r.k for r in df.select("i", C.permutation_rank(A).alias("k")).collect())
    assert len(orders) == math.factorial(n)


def test_states_and_runs_of_long_arrays(spark):
    n = 20_000
    a = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % 7 < 3).cast("long"))
    began = time.time()
    row = spark.range(1).select(
        C.trace(a, F.lit(0).cast("long"), lambda s, x: s * 3 % 1000 + x).alias("states"), C.runs(a).alias("runs")
    ).first()
    assert time.time() - began < 20
    states = [0]
    for x in range(1, n + 1):
        states.append(states[-1] * 3 % 1000 + (x % 7 < 3))
    assert row.states == states
    assert row.runs == [list(g) for _, g in itertools.groupby(int(x % 7 < 3) for x in range(1, n + 1))]


def test_states_of_short_arrays(spark):
    df = spark.createDataFrame([(k, list(range(k))) for k in range(12)] + [(99, None)], "k int, a array<long>")
    got = {r.k: r.s for r in df.select("k", C.trace(F.col("a"), F.lit(5).cast("long"), lambda s, x: s + x).alias("s")).collect()}
    assert got == {k: [5 + sum(range(i)) for i in range(k + 1)] for k in range(12)} | {99: None}
