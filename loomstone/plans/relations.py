"""Queries over joins, intervals, set operations and relation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import relational as R
from loomstone.plans.registry import Registry, dealt, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")


@_R.add("q_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner(spark, sf_dir):
    return _orders(spark, sf_dir).join(_customers(spark, sf_dir), "o_custkey").select("o_orderkey", "c_name")


@_R.add("q_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left(spark, sf_dir):
    joined = _customers(spark, sf_dir).join(_orders(spark, sf_dir), "o_custkey", "left")
    return joined.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))


@_R.add("q_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey * 2 FROM orders)")
def semi(spark, sf_dir):
    doubled = _orders(spark, sf_dir).withColumn("o_custkey", F.col("o_custkey") * 2)
    return _customers(spark, sf_dir).join(doubled, "o_custkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))


@_R.add("q_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)")
def anti(spark, sf_dir):
    doubled = _orders(spark, sf_dir).withColumn("o_custkey", F.col("o_custkey") * 2)
    return _customers(spark, sf_dir).join(doubled, "o_custkey", "left_anti").select(F.col("o_custkey").alias("c_custkey"))


@_R.add(
    "q_full",
    """
    WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1),
         b AS (SELECT s_nationkey + 5 AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
    SELECT k, customers, suppliers FROM a FULL JOIN b USING (k)
    """,
)
def full(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") + 5).alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@_R.add(
    "q_star",
    """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE c_nationkey = s_nationkey AND r_name = 'ASIA' GROUP BY 1
    """,
)
def star(spark, sf_dir):
    """Revenue of local suppliers: a join over six tables, ordered by the optimizer."""
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@_R.add(
    "q_skewed_join",
    "SELECT l_returnflag, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def skewed_join(spark, sf_dir):
    """An equality join with its keys dealt over several tasks each."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return R.skewed_join(lines, parts, ["l_partkey"], 4).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@_R.add(
    "q_range_join",
    """
    WITH a AS (SELECT s_suppkey AS a, s_acctbal AS a0, s_acctbal + 40 AS a1 FROM supplier),
         b AS (SELECT c_custkey AS b, c_acctbal AS b0, c_acctbal + 15 AS b1 FROM customer)
    SELECT a, b, round(greatest(a0, b0), 4) AS overlap_start, round(least(a1, b1), 4) AS overlap_finish FROM a JOIN b ON a0 < b1 AND b0 < a1
    """,
)
def range_join(spark, sf_dir):
    """All overlapping intervals of two tables, by bins."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("a0"), (F.col("s_acctbal") + 40).alias("a1"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("b0"), (F.col("c_acctbal") + 15).alias("b1"))
    # Rounding keeps the order, so that each interval's ends are rounded once and not those of each pair.
    near = lambda df, *ends: df.withColumns({f"{e}_near": F.round(e, 4) for e in ends})
    found = R.range_join(near(a, "a0", "a1"), dealt(near(b, "b0", "b1")), "a0", "a1", "b0", "b1", 40.0)
    return found.select("a", "b", F.greatest("a0_near", "b0_near").alias("overlap_start"), F.least("a1_near", "b1_near").alias("overlap_finish"))


def _sides(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'click'").groupBy("user_id", F.col("ts").alias("seen")).agg(F.max("event_id").alias("click"))
    return left, right


_ASOF = """
    WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
         r AS (SELECT user_id, ts AS seen, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT l.event_id, r.click FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts {} r.seen
"""


@_R.add("q_asof", _ASOF.format(">="))
def asof(spark, sf_dir):
    """Each purchase with the last click at or before it."""
    left, right = _sides(spark, sf_dir)
    return R.asof_join(left, right, "ts", "seen", ["user_id"]).select("event_id", "click")


@_R.add("q_asof_forward", _ASOF.format("<"))
def asof_forward(spark, sf_dir):
    """Each purchase with the first click strictly after it."""
    left, right = _sides(spark, sf_dir)
    return R.asof_join(left, right, "ts", "seen", ["user_id"], forward=True, strict=True).select("event_id", "click")


@_R.add(
    "q_interval_merge",
    """
    WITH a AS (SELECT user_id, ts AS start, ts + INTERVAL 6 HOUR AS finish FROM events),
         b AS (SELECT *, CASE WHEN start >= max(finish) OVER w THEN 1 WHEN max(finish) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM a
               WINDOW w AS (PARTITION BY user_id ORDER BY start, finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
         c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, finish ROWS UNBOUNDED PRECEDING) AS g FROM b)
    SELECT user_id, epoch_us(min(start)) AS start_us, epoch_us(max(finish)) AS finish_us FROM c GROUP BY user_id, g
    """,
)
def interval_merge(spark, sf_dir):
    """Six hours after each event, united where they overlap."""
    six = F.expr("interval 6 hours")
    spans = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("start"), (F.col("ts").cast("timestamp") + six).alias("finish"))
    merged = R.merge_intervals(spans, "start", "finish", ["user_id"])
    return merged.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("finish").alias("finish_us"))


_A, _B = "SELECT c_nationkey * 2 AS k FROM customer", "SELECT s_nationkey * 3 AS k FROM supplier"


def _near(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 2).alias("k"))
    return a, table(spark, sf_dir, "supplier").select((F.col("s_nationkey") * 3).alias("k"))


@_R.add("q_union", f"{_A} UNION {_B}")
def union(spark, sf_dir):
    return R.union(*_near(spark, sf_dir))


@_R.add("q_intersect", f"{_A} INTERSECT {_B}")
def intersect(spark, sf_dir):
    return R.intersect(*_near(spark, sf_dir))


@_R.add("q_except", f"{_A} EXCEPT {_B}")
def except_(spark, sf_dir):
    return R.difference(*_near(spark, sf_dir))


@_R.add("q_bag_union", f"{_A} UNION ALL {_B}")
def bag_union(spark, sf_dir):
    a, b = _near(spark, sf_dir)
    return a.unionAll(b)


@_R.add(
    "q_collate",
    """
    WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1),
         b AS (SELECT s_nationkey + 5 AS k, count(*) AS n FROM supplier GROUP BY 1)
    SELECT k, CASE WHEN a.n IS NULL THEN b.n WHEN b.n IS NULL THEN a.n ELSE a.n * 100 + b.n END AS n FROM a FULL JOIN b USING (k)
    """,
)
def collate(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") + 5).alias("k")).agg(F.count("*").alias("n"))
    return R.collate(a, b, ["k"], "n", lambda x, y: x * 100 + y)


@_R.add(
    "q_upsert",
    """
    SELECT p_partkey, p_name, p_size FROM part WHERE p_size <= 45
    UNION ALL SELECT p_partkey, upper(p_name), p_size + 100 FROM part WHERE p_size > 45
    """,
)
def upsert(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    changes = parts.filter("p_size > 45").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 100).alias("p_size"))
    return R.upsert(parts, changes, ["p_partkey"])


@_R.add(
    "q_contrast",
    """
    WITH a AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation FROM supplier WHERE s_acctbal > -500),
         b AS (SELECT s_suppkey AS k, CASE WHEN s_nationkey < 5 THEN 'x' ELSE s_name END AS name, s_nationkey AS nation FROM supplier WHERE s_acctbal < 9000)
    SELECT k, CASE WHEN b.name IS NULL THEN 'left' WHEN a.name IS NULL THEN 'right' WHEN a.name = b.name THEN 'same' ELSE 'different' END AS status,
           CASE WHEN a.name <> b.name THEN 'name' ELSE '' END AS changed FROM a FULL JOIN b USING (k)
    """,
)
def contrast(spark, sf_dir):
    """What differs between two versions of a table."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    edited = s.filter("s_acctbal < 9000").withColumn("name", F.when(F.col("nation") < 5, "x").otherwise(F.col("name")))
    found = R.contrast(s.filter("s_acctbal > -500").drop("s_acctbal"), edited.drop("s_acctbal"), ["k"])
    return found.withColumn("changed", F.array_join("changed", ","))


@_R.add("q_intern", "SELECT c_mktsegment AS value, dense_rank() OVER (ORDER BY c_mktsegment) AS ref FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def intern(spark, sf_dir):
    return R.store(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")), ["value"])


@_R.add(
    "q_lookup",
    """
    SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')
    """,
)
def lookup(spark, sf_dir):
    """Regions and nations as interned values, joined through a relation of references."""
    regions = R.store(table(spark, sf_dir, "region").select("r_name"), ["r_name"], "left")
    nations = R.store(table(spark, sf_dir, "nation").select("n_name"), ["n_name"])
    pairs = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(regions, "r_name")
        .join(nations, "n_name")
        .select("left", F.col("ref").alias("right"))
    )
    wanted = regions.filter(F.col("r_name").isin("ASIA", "EUROPE"))
    return R.lookup(pairs, wanted, nations).join(wanted, "left").select("r_name", "n_name")


@_R.add("q_unassign", "SELECT n_regionkey AS \"left\", n_nationkey AS \"right\" FROM nation WHERE n_regionkey <> 2")
def unassign(spark, sf_dir):
    pairs = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("left"), F.col("n_nationkey").alias("right"))
    return R.unassign(R.assign(pairs, pairs), pairs.filter(F.col("left") == 2))
