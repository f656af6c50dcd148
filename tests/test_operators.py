"""Operators on small tables with nulls, ties and nothing, against plain versions."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.operators import diff
from loomstone.operators import graph as G
from loomstone.operators import relational as R
from loomstone.operators import sequence as S
from loomstone.operators import sketch


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_indexed_over_partitions(spark):
    values = random.Random(1).sample(range(1000), 300)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    assert rows(S.indexed(df, ["v"]), "index", "v") == sorted([(i, v) for i, v in enumerate(sorted(values))], key=str)
    assert S.indexed(df.limit(0), ["v"]).count() == 0
    assert "index" in S.indexed(df.withColumn("part", F.lit(1)), ["v"]).columns


def test_running_sum_over_blocks(spark):
    values = list(range(50, 0, -1))
    df = spark.createDataFrame([(v, v % 7) for v in values], "v long, x long").repartition(5)
    want = dict(zip(sorted(values), itertools.accumulate(v % 7 for v in sorted(values)), strict=True))
    assert dict(rows(S.trace_sum(df, F.col("x"), ["v"], block=8), "v", "state")) == want


RUNS = list("aabbba") + [None, None]


def test_runs_and_trains(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(RUNS)] + [(2, 0, "a")], "g int, i int, c string")
    assert rows(S.runs(df, F.col("c"), ["i"], ["g"]), "g", "run", "key", "length") == sorted([(1, 0, "a", 2), (1, 1, "b", 3), (1, 2, "a", 1), (1, 3, None, 2), (2, 0, "a", 1)], key=str)
    assert rows(S.longest_train(df, F.col("c") == "a", ["i"], ["g"]), "g", "start", "length") == [(1, 0, 2), (2, 0, 1)]
    ties = spark.createDataFrame([(1, i, x) for i, x in enumerate([1, 1, 0, 1, 1])], "g int, i int, x int")
    assert rows(S.longest_train(ties, F.col("x") == 1, ["i"], ["g"]), "start", "length") == [(0, 2)]
    assert S.longest_train(ties, F.col("x") == 9, ["i"], ["g"]).count() == 0


def test_prefix_runs(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([1, 2, 9, 1, None, 2])], "g int, i int, x int")
    small = F.col("x") < 5
    assert rows(S.keep_while(df, small, ["i"], ["g"]), "i") == [(0,), (1,)]
    assert rows(S.skip_while(df, small, ["i"], ["g"]), "i") == [(2,), (3,), (4,), (5,)]
    assert rows(S.keep_while(df, small, ["i"], ["g"], trailing=True), "i") == [(5,)]
    assert [r.inside for r in S.span(df, small, ["i"], ["g"]).orderBy("i").collect()] == [True, True, False, False, False, False]


def test_windows_zip_and_weave(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)], "g int, i int")
    assert [r.window for r in S.slide(df, 3, F.col("i"), ["i"], ["g"]).orderBy("i").collect()] == [[0, 1, 2], [1, 2, 3], [2, 3, 4]]
    assert S.slide(df, 9, F.col("i"), ["i"], ["g"]).count() == 0
    a, b = spark.range(3).select(F.col("id").alias("a")), spark.range(10, 15).select(F.col("id").alias("b"))
    assert rows(S.zip_rows(a, b, ["a"], ["b"]), "a", "b") == [(0, 10), (1, 11), (2, 12)]
    woven = S.weave(a.select(F.col("a").alias("v")), b.select(F.col("b").alias("v")), ["v"], ["v"])
    assert [r.v for r in woven.orderBy("index").collect()] == [0, 10, 1, 11, 2, 12]
    assert rows(S.excerpt(df, 1, 3, ["i"]), "i") == [(1,), (2,)] and rows(S.keep(df, 2, ["i"], last=True), "i") == [(3,), (4,)]
    yes, no = S.partition(df, F.col("i") > 2)
    assert (yes.count(), no.count()) == (2, 3)


def test_range_join_agrees_with_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: [(i, (x := rng.uniform(-50, 50)), x + rng.choice([0, 0.5, 3, 40])) for i in range(n)]
    a, b = make(40), make(50)
    found = R.range_join(
        spark.createDataFrame(a, "a int, a0 double, a1 double"), spark.createDataFrame(b, "b int, b0 double, b1 double"), "a0", "a1", "b0", "b1", 5.0
    )
    want = sorted([(x[0], y[0]) for x in a for y in b if x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]], key=str)
    assert rows(found, "a", "b") == want


@pytest.mark.parametrize("forward,strict", itertools.product([False, True], repeat=2))
def test_asof_agrees_with_search(spark, forward, strict):
    rng = random.Random(3)
    left = [(i, rng.choice("xy"), rng.randrange(20)) for i in range(40)] + [(99, "z", 5)]
    right = [(g, t, f"{g}{t}") for g in "xy" for t in rng.sample(range(20), 8)]
    found = R.asof_join(
        spark.createDataFrame(left, "i int, g string, t int"), spark.createDataFrame(right, "g string, s int, v string"), "t", "s", ["g"], forward, strict
    )

    def search(g, t):
        ok = lambda s: (s > t or (s == t and not strict)) if forward else (s < t or (s == t and not strict))
        hits = sorted(s for h, s, _ in right if h == g and ok(s))
        return None if not hits else f"{g}{hits[0] if forward else hits[-1]}"

    assert rows(found, "i", "v") == sorted([(i, search(g, t)) for i, g, t in left], key=str)


def test_intervals_that_touch_stay_apart(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 3, 6), (1, 3, 4), (1, 9, 9), (2, 1, 2)], "g int, s int, f int")
    assert rows(R.merge_intervals(df, "s", "f", ["g"]), "g", "s", "f") == [(1, 0, 2), (1, 2, 6), (2, 1, 2)]


def test_merging_by_key(spark):
    a, b = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int"), spark.createDataFrame([(2, 5), (3, 7)], "k int, v int")
    assert rows(R.collate(a, b, ["k"], "v", lambda x, y: x - y), "k", "v") == [(1, 10), (2, 15), (3, 7)]
    assert rows(R.upsert(a, b, ["k"]), "k", "v") == [(1, 10), (2, 5), (3, 7)]
    assert rows(R.establish(a, spark.createDataFrame([(1,), (9,)], "k int"), ["k"], "v", F.col("k") * 100), "k", "v") == [(1, 10), (9, 900)]
    assert rows(R.contrast(a, b, ["k"]), "k", "status", "changed") == [(1, "left", []), (2, "different", ["v"]), (3, "right", [])]
    assert rows(R.skewed_join(a, b.withColumnRenamed("v", "w"), ["k"], 3), "k", "v", "w") == [(2, 20, 5)]


def test_relations(spark):
    shelf = R.store(spark.createDataFrame([("a",), ("b",), ("a",)], "name string"), ["name"])
    assert rows(shelf, "ref", "name") == [(1, "a"), (2, "b")]
    assert rows(R.reference(spark.createDataFrame([("b",), ("z",)], "name string"), shelf, ["name"]), "name", "ref") == [("b", 2), ("z", None)]
    none = spark.createDataFrame([], "left long, right long")
    pairs = R.assign(R.assign(none, spark.createDataFrame([(7, 1), (7, 2)], none.schema)), spark.createDataFrame([(7, 1)], none.schema))
    ask = spark.createDataFrame([(7,), (8,)], "left long")
    assert rows(R.lookup(pairs, ask, shelf), "left", "name") == [(7, "a"), (7, "b")]
    assert rows(R.lookup(R.unassign(pairs, spark.createDataFrame([(7, 1)], none.schema)), ask, shelf), "name") == [("b",)]
    assert rows(R.dereference(spark.createDataFrame([(2,)], "ref long"), shelf), "name") == [("b",)]


EDGES = [(8, 4), (8, 6), (6, 3), (6, 2), (4, 2)]


def edges_of(spark, edges=EDGES):
    return spark.createDataFrame(edges, "src int, dst int")


def test_graphs(spark):
    e = edges_of(spark)
    assert rows(G.closure(e), "src", "dst") == sorted([*EDGES, (8, 3), (8, 2)])
    assert rows(G.reduction(G.closure(e)), "src", "dst") == sorted(EDGES)
    place = dict(rows(G.topological(e), "id", "place"))
    assert sorted(place.values()) == list(range(5)) and all(place[a] > place[b] for a, b in EDGES)
    assert rows(G.sources(e), "id") == [(2,), (3,)]
    assert rows(G.descendants(e, spark.createDataFrame([(6,)], "id int")), "src", "dst") == [(6, 2), (6, 3)]
    assert rows(G.ancestors(e, spark.createDataFrame([(2,)], "id int")), "src", "dst") == [(4, 2), (6, 2), (8, 4), (8, 6)]
    assert G.ancestors(e, spark.createDataFrame([(8,)], "id int")).count() == 0
    assert rows(G.remove_vertex(e, spark.createDataFrame([(6,)], "id int")), "src", "dst") == [(4, 2), (8, 2), (8, 3), (8, 4)]
    assert rows(G.fold_up(e, spark.createDataFrame([(v, 1) for v in (2, 3, 4, 6, 8)], "id int, value int")), "id", "total") == [(2, 1), (3, 1), (4, 2), (6, 3), (8, 6)]
    assert rows(G.explore(spark.createDataFrame([(8,)], "id int"), e, 1), "id", "depth") == [(4, 1), (6, 1), (8, 0)]
    assert not G.has_cycle(e)


def test_graphs_with_cycles_chains_and_nothing(spark):
    loop = edges_of(spark, [(1, 2), (2, 1), (3, 3)])
    assert G.has_cycle(loop) and (1, 1) in rows(G.closure(loop), "src", "dst")
    with pytest.raises(G.CyclicGraph):
        G.levels(loop)
    chain = edges_of(spark, [(i, i + 1) for i in range(30)])
    assert dict(rows(G.levels(chain), "id", "level")) == {i: 30 - i for i in range(31)}
    none = spark.createDataFrame([], "src int, dst int")
    assert G.closure(none).count() == 0 and G.levels(none).count() == 0 and not G.has_cycle(none)


def test_partial_order_of_divisors(spark):
    d = [1, 2, 3, 4, 6, 12]
    elements = spark.createDataFrame([(x,) for x in d], "id int")
    order = spark.createDataFrame([(a, b) for a in d for b in d if a < b and b % a == 0], "low int, high int")
    assert rows(G.covers(order), "low", "high") == sorted([(1, 2), (1, 3), (2, 4), (2, 6), (3, 6), (4, 12), (6, 12)], key=str)
    assert rows(G.maxima(elements, order), "id") == [(12,)] and rows(G.minima(elements, order), "id") == [(1,)]
    assert G.with_bottom(elements, order, 0).count() == order.count() + 6


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    shape = sketch.Bloom(1000, 0.01)
    some, others = spark.range(1000), spark.range(10_000, 20_000)
    half = [sketch.build(some.filter(f"id % 2 = {k}"), F.col("id"), shape) for k in (0, 1)]
    made = sketch.merge(*half)
    assert sketch.probe(some, F.col("id"), made, shape).filter("maybe").count() == 1000
    assert sketch.probe(others, F.col("id"), made, shape).filter("maybe").count() < 200


def test_fuzzy_search_agrees_with_all_pairs(spark):
    terms, queries = ["apple", "apply", "ape", "maple", "", "a"], ["appl", "aple", "b", "aplpe"]
    found = sketch.fuzzy_search(spark.createDataFrame([(t,) for t in terms], "t string"), spark.createDataFrame([(q,) for q in queries], "q string"), "t", "q", 2)
    pairs = spark.createDataFrame([(q, t) for q in queries for t in terms], "query string, term string").withColumn("distance", F.levenshtein("query", "term"))
    assert rows(found, "query", "term", "distance") == rows(pairs.filter("distance <= 2"), "query", "term", "distance")


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_scripts_are_shortest(a, b):
    script = diff._script(a, b)
    assert [e["value"] for e in script if e["op"] != "ins"] == a and [e["value"] for e in script if e["op"] != "del"] == b
    assert sum(e["op"] != "keep" for e in script) == len(a) + len(b) - 2 * lcs(a, b)
    assert all(a[e["left"]] == e["value"] for e in script if e["left"] is not None)
    assert all(b[e["right"]] == e["value"] for e in script if e["right"] is not None)


def test_scripts_as_columns(spark):
    df = spark.createDataFrame([(1, list("ac"), list("abc")), (2, [], ["x"]), (3, None, ["x"])], "k int, a array<string>, b array<string>")
    s = F.col("s")
    made = df.withColumn("s", diff.diff("a", "b")).orderBy("k")
    got = made.select(diff.size(s).alias("n"), diff.patch(s).alias("p"), diff.original(diff.flip(s)).alias("f"), diff.unified(s).alias("u"), diff.applies(s, F.col("a")).alias("ok")).collect()
    assert (got[0].n, got[0].p, got[0].f, got[0].u, got[0].ok) == (1, ["a", "b", "c"], ["a", "b", "c"], " a\n+b\n c", True)
    assert got[2].p is None
    hunks = rows(diff.hunks(made.filter("k = 1"), ["k"], "s"), "hunk", "changed", "added", "removed")
    assert hunks == [(0, False, [], []), (1, True, ["b"], []), (2, False, [], [])]
    versions = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 2, "b")], "doc int, v int, line string")
    assert rows(diff.version_of(diff.evolve(versions, "doc", "v", "line"), 2), "line") == [("a",), ("b",)]


def test_names_that_clash_and_null_keys(spark):
    left = spark.createDataFrame([(1, 5, 1.0, 2.0)], "g int, t int, right_ double, time_ double")
    right = spark.createDataFrame([(1, 4, 9.0)], "g int, u int, carried_ double")
    row = R.asof_join(left, right, "t", "u", ["g"]).first()
    assert tuple(row) == (1, 5, 1.0, 2.0, 4, 9.0)
    spans = lambda a, b, c: spark.createDataFrame([(0.0, 2.0, 7)], f"{a} double, {b} double, {c} int")
    assert set(R.range_join(spans("a", "b", "bin_"), spans("c", "d", "e"), "a", "b", "c", "d", 1.0).columns) >= {"bin_", "e"}
    nulls = spark.createDataFrame([(None, 1), (2, 2)], "a_ int, v int")
    merged = R.collate(nulls, nulls, ["a_"], "v", lambda x, y: x + y)
    assert sorted(map(tuple, merged.collect()), key=str) == [(2, 4), (None, 2)]
    changed = R.upsert(nulls, spark.createDataFrame([(None, 9)], "a_ int, v int"), ["a_"])
    assert sorted(map(tuple, changed.collect()), key=str) == [(2, 2), (None, 9)]
    known = R.establish(nulls, spark.createDataFrame([(None,), (3,)], "a_ int"), ["a_"], "v", F.lit(0))
    assert sorted(map(tuple, known.collect()), key=str) == [(3, 0), (None, 1)]


def test_skewed_join_keeps_rows_once(spark):
    big = spark.createDataFrame([(1, "x"), (1, "x"), (3, "y")], "k int, v string").repartition(3)
    small = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(tuple, R.skewed_join(big, small, ["k"], 4, how).collect()), key=str)
        assert got == sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            R.skewed_join(big, small, ["k"], 4, how)


def test_windows_over_a_whole_table_are_refused(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        S.trace(df, F.col("id"), ["id"], [])


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0, 0.0, 0.0, 0.0]), (63, [2.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, e array<double>").repartition(3)
    unit = {i: np.array(e) / np.linalg.norm(e) for i, e in rows if e and any(e)}
    want = {}
    for q in (0, 5, 62):
        ranked = sorted(((-round(float(unit[q] @ u), 6), i) for i, u in unit.items() if i != q))[:4]
        want[q] = [(i, -c) for c, i in ranked]
    for block in (1, 2, 2_048):
        monkeypatch.setattr(sketch, "BLOCK", block)
        found = sketch.nearest(v, v.filter("id IN (0, 5, 60, 62)"), "id", "e", 4).orderBy("query", "rank").collect()
        got = {q: [(r.id, pytest.approx(r.cosine)) for r in found if r.query == q] for q in want}
        assert got == want
    assert sketch.nearest(v, v.limit(0), "id", "e", 4).count() == 0


def test_diff_holds_one_script_as_objects():
    import tracemalloc

    import pyarrow as pa

    a = pa.array([[f"w{i % 7}" for i in range(400)]] * 300)
    b = pa.array([[f"w{i % 5}" for i in range(400)]] * 300)
    tracemalloc.start()
    found = diff.diff.func(a.slice(0, 20), b.slice(0, 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 20 and peak < 2_000_000
    assert diff.diff.func(pa.array([None, ["x"]], pa.list_(pa.string())), pa.array([["y"], ["x"]])).to_pylist()[0] is None
