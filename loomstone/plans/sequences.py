"""Queries over ordered rows and array columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import collections as C
from loomstone.operators import sequence as S
from loomstone.plans.registry import Registry, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
_ORDER, _BY = ["ts", "event_id"], ["user_id"]
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@_R.add("q_indexed", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS index FROM events")
def indexed(spark, sf_dir):
    """The place of every row in the whole table, numbered range by range."""
    return S.indexed(_events(spark, sf_dir).select("event_id", "ts"), _ORDER).select("event_id", "index")


@_R.add("q_indexed_by", f"SELECT event_id, user_id, row_number() {_W} - 1 AS index FROM events")
def indexed_by(spark, sf_dir):
    return S.indexed(_events(spark, sf_dir), _ORDER, _BY).select("event_id", "user_id", "index")


@_R.add(
    "q_runs",
    f"""
    WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) {_W} THEN 0 ELSE 1 END AS new FROM events),
         b AS (SELECT *, sum(new) {_W} - 1 AS run FROM a)
    SELECT user_id, run::BIGINT AS run, min(event_type) AS key, count(*) AS length FROM b GROUP BY 1, 2
    """,
)
def runs(spark, sf_dir):
    """Maximal runs of one kind of event of each user."""
    return S.runs(_events(spark, sf_dir), F.col("event_type"), _ORDER, _BY).withColumn("run", F.col("run").cast("long"))


@_R.add(
    "q_longest_train",
    f"""
    WITH a AS (SELECT *, row_number() {_W} - 1 AS place, value > 20 AS ok FROM events),
         b AS (SELECT *, place - row_number() OVER (PARTITION BY user_id, ok ORDER BY ts, event_id) AS g FROM a),
         c AS (SELECT user_id, min(place) AS start, count(*) AS length FROM b WHERE ok GROUP BY user_id, g)
    SELECT user_id, start, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS n FROM c) WHERE n = 1
    """,
)
def longest_train(spark, sf_dir):
    """The first longest train of events above a value."""
    return S.longest_train(_events(spark, sf_dir), F.col("value") > 20, _ORDER, _BY)


@_R.add("q_trace", f"SELECT event_id, round(sum(value) {_W}, 4) AS state FROM events")
def trace(spark, sf_dir):
    found = S.trace(_events(spark, sf_dir), F.col("value"), _ORDER, _BY)
    return found.select("event_id", F.round("state", 4).alias("state"))


@_R.add("q_trace_sum", "SELECT o_orderkey, sum((o_totalprice * 100)::BIGINT) OVER (ORDER BY o_orderdate, o_orderkey)::BIGINT AS state FROM orders")
def trace_sum(spark, sf_dir):
    """A running sum over a whole table, block by block."""
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return S.trace_sum(orders, cents, ["o_orderdate", "o_orderkey"], block=5_000).select("o_orderkey", "state")


@_R.add(
    "q_slide",
    f"""
    SELECT event_id, array_to_string(w, ',') AS window FROM (
        SELECT event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM events)
    WHERE len(w) = 3
    """,
)
def slide(spark, sf_dir):
    found = S.slide(_events(spark, sf_dir), 3, F.col("event_id"), _ORDER, _BY)
    return found.select("event_id", F.array_join("window", ",").alias("window"))


@_R.add(
    "q_batched",
    f"SELECT user_id, n // 10 AS batch, count(*) AS size, sum(event_id)::BIGINT AS ids FROM (SELECT *, row_number() {_W} - 1 AS n FROM events) GROUP BY 1, 2",
)
def batched(spark, sf_dir):
    found = S.batched(_events(spark, sf_dir), 10, _ORDER, _BY)
    return found.groupBy("user_id", "batch").agg(F.count("*").alias("size"), F.sum("event_id").alias("ids"))


@_R.add(
    "q_span",
    """
    WITH a AS (SELECT *, min((o_totalprice < 300000)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
               ROWS UNBOUNDED PRECEDING) AS ok FROM orders)
    SELECT o_orderkey, ok = 1 AS inside FROM a
    """,
)
def span(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return S.span(orders, F.col("o_totalprice") < 300000, ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "inside")


_CHEAP = "SELECT *, min((o_totalprice < 300000)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate {}, o_orderkey {} ROWS UNBOUNDED PRECEDING) AS ok FROM orders"


@_R.add("q_take_while", f"SELECT o_orderkey FROM ({_CHEAP.format('', '')}) WHERE ok = 1")
def take_while(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_totalprice")
    return S.keep_while(orders, F.col("o_totalprice") < 300000, ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey")


@_R.add("q_drop_while_trailing", f"SELECT o_orderkey FROM ({_CHEAP.format('DESC', 'DESC')}) WHERE ok = 0")
def drop_while_trailing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_totalprice")
    return S.skip_while(orders, F.col("o_totalprice") < 300000, ["o_orderdate", "o_orderkey"], ["o_custkey"], True).select("o_orderkey")


@_R.add("q_excerpt", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def excerpt(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return S.excerpt(orders, 100, 150, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@_R.add(
    "q_zip",
    """
    SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
    JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS n FROM supplier) USING (n)
    """,
)
def zip_rows(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey")
    right = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return S.zip_rows(left, right, ["c_custkey"], ["s_acctbal", "s_suppkey"]).select("c_custkey", "s_suppkey")


@_R.add(
    "q_weave",
    """
    WITH a AS (SELECT c_name AS name, 2 * (row_number() OVER (ORDER BY c_name) - 1) AS index FROM customer),
         b AS (SELECT s_name AS name, 2 * (row_number() OVER (ORDER BY s_name) - 1) + 1 AS index FROM supplier)
    SELECT name, index FROM (FROM a UNION ALL FROM b)
    WHERE index < 2 * least((SELECT count(*) FROM customer), (SELECT count(*) FROM supplier))
    """,
)
def weave(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return S.weave(left, right, ["name"], ["name"])


@_R.add(
    "q_distinct_first",
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
)
def distinct_first(spark, sf_dir):
    return S.first_only(_events(spark, sf_dir), ["user_id", "event_type"], _ORDER).select("user_id", "event_type", "event_id")


@_R.add(
    "q_index_by_last",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def index_by_last(spark, sf_dir):
    return S.last_only(_events(spark, sf_dir), _BY, _ORDER).select("user_id", "event_id", "value")


@_R.add("q_seek", "SELECT event_id FROM events WHERE value > 90 ORDER BY ts, event_id LIMIT 1")
def seek(spark, sf_dir):
    return S.seek(_events(spark, sf_dir), F.col("value") > 90, _ORDER).select("event_id")


@_R.add("q_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def topk(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return S.top_k(lines, 20, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")])


@_R.add(
    "q_topk_per_group",
    """
    SELECT l_suppkey, l_orderkey, l_linenumber, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3
    """,
)
def topk_per_group(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    found = S.top_k_by(lines, 3, ["l_suppkey"], order)
    return found.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@_R.add(
    "q_skip",
    "SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey OFFSET 5",
)
def skip(spark, sf_dir):
    return S.skip(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), 5, ["s_acctbal", "s_suppkey"]).select("s_suppkey")


def _sizes(spark, sf_dir):
    """Each brand's part sizes in the order of their keys, as an array."""
    parts = table(spark, sf_dir, "part")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda s: s["p_size"])
    return parts.groupBy("p_brand").agg(ordered.alias("a"))


_A = "WITH t AS (SELECT p_brand, list(p_size ORDER BY p_partkey) AS a FROM part GROUP BY 1)"
_S = "array_to_string({}, ',')"


@_R.add(
    "q_array_slices",
    f"""{_A} SELECT p_brand, {_S.format('a[1:3]')} AS kept, {_S.format('a[4:]')} AS skipped, {_S.format('a[greatest(1, len(a) - 1):]')} AS tail,
    {_S.format('a[3:5]')} AS mid, {_S.format('list_reverse(a)')} AS turned, {_S.format('list_distinct_ordered')} AS firsts
    FROM (SELECT *, list_transform(list_filter(list_transform(a, lambda x, i: {{'x': x, 'i': i}}), lambda s: list_position(a, s.x) = s.i), lambda s: s.x)
    AS list_distinct_ordered FROM t)""",
)
def array_slices(spark, sf_dir):
    """Positional segments of arrays."""
    a, j = F.col("a"), lambda c: F.array_join(c.cast("array<string>"), ",")
    return _sizes(spark, sf_dir).select(
        "p_brand",
        j(C.keep(a, 3)).alias("kept"),
        j(C.skip(a, 3)).alias("skipped"),
        j(C.keep(a, 2, right=True)).alias("tail"),
        j(C.excerpt(a, 2, 5)).alias("mid"),
        j(F.reverse(a)).alias("turned"),
        j(C.distinct(a)).alias("firsts"),
    )


@_R.add(
    "q_array_search",
    f"""{_A}, u AS (SELECT *, list_position(list_transform(a, lambda x: x > 40), true) AS k FROM t)
    SELECT p_brand, (k - 1)::BIGINT AS place, a[k]::BIGINT AS first, len(list_filter(a, lambda x: x > 40))::BIGINT AS n,
           {_S.format('CASE WHEN k IS NULL THEN a ELSE a[1:k - 1] END')} AS leading, {_S.format('CASE WHEN k IS NULL THEN [] ELSE a[k:] END')} AS rest
    FROM u""",
)
def array_search(spark, sf_dir):
    """The first match of a predicate, and the run before it."""
    a, j = F.col("a"), lambda c: F.array_join(c.cast("array<string>"), ",")
    big = lambda x: x > 40
    parts = C.span(a, lambda x: x <= 40)
    return _sizes(spark, sf_dir).select(
        "p_brand",
        C.where(a, big).cast("long").alias("place"),
        C.seek(a, big).cast("long").alias("first"),
        C.count(a, big).cast("long").alias("n"),
        j(parts["left"]).alias("leading"),
        j(parts["right"]).alias("rest"),
    )


@_R.add(
    "q_array_shapes",
    f"""{_A} SELECT p_brand, len(a) // 4 + (len(a) % 4 > 0)::INT AS batches, greatest(len(a) - 2, 0)::BIGINT AS windows,
    (SELECT sum(CASE WHEN i = 1 OR a[i] <> a[i - 1] THEN 1 ELSE 0 END)::BIGINT FROM (SELECT unnest(range(1, len(a) + 1)) AS i)) AS runs,
    {_S.format('list_transform(a, lambda x, i: list_sum(a[1:i])::BIGINT)')} AS sums FROM t""",
)
def array_shapes(spark, sf_dir):
    """Batches, windows, runs and running states of arrays."""
    a = F.col("a")
    states = C.trace(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return _sizes(spark, sf_dir).select(
        "p_brand",
        F.size(C.batched(a, 4)).cast("long").alias("batches"),
        F.size(C.slide(a, 3)).cast("long").alias("windows"),
        F.size(C.runs(a)).cast("long").alias("runs"),
        F.array_join(C.skip(states, 1).cast("array<string>"), ",").alias("sums"),
    )


@_R.add(
    "q_array_zip",
    f"""{_A} SELECT p_brand, {_S.format('list_transform(list_zip(a[1:len(a) - 1], a[2:]), lambda p: p[1]::VARCHAR || chr(47) || p[2]::VARCHAR)')} AS pairs,
    {_S.format('flatten(list_transform(list_zip(a[1:2], list_reverse(a)[1:2]), lambda p: [p[1], p[2]]))')} AS woven FROM t""",
)
def array_zip(spark, sf_dir):
    """Neighbours in pairs, and two arrays in turn."""
    a = F.col("a")
    pairs = F.transform(C.zip_(a, C.skip(a, 1)), lambda p: F.concat_ws("/", p["left"], p["right"]))
    woven = C.weave(C.keep(a, 2), F.reverse(a))
    return _sizes(spark, sf_dir).select("p_brand", F.array_join(pairs, ",").alias("pairs"), F.array_join(woven.cast("array<string>"), ",").alias("woven"))


@_R.add(
    "q_map_collate",
    """
    WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value < 60 GROUP BY 1, 2),
         b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS merged
    FROM (SELECT user_id, event_type, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b USING (user_id, event_type))
    WHERE user_id IN (SELECT user_id FROM a) AND user_id IN (SELECT user_id FROM b) GROUP BY 1
    """,
)
def map_collate(spark, sf_dir):
    """Two maps of counts per user as one, with counts of common keys added."""

    def counts(condition, name):
        found = table(spark, sf_dir, "events").filter(condition).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
        return found.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(name))

    both = counts("value < 60", "a").join(counts("value > 20", "b"), "user_id")
    merged = F.array_sort(F.map_entries(C.collate(F.col("a"), F.col("b"), lambda x, y: x + y)))
    return both.select("user_id", F.array_join(F.transform(merged, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))
