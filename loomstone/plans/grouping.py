"""Queries over grouping and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import stats
from loomstone.plans.registry import Registry, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.add(
    "q_group_total",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
           round(avg(l_discount), 6) AS avg_discount, count(*) AS n_rows
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
    """,
)
def group_total(spark, sf_dir):
    """Pricing summary: filter, group, total, sort."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(stats.total(F.col("l_quantity")), 2).alias("sum_qty"),
            F.round(stats.total(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.round(stats.mean(F.col("l_discount")), 6).alias("avg_discount"),
            F.count("*").alias("n_rows"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@_R.add(
    "q_group_stats",
    """
    SELECT l_suppkey, count(*) AS n, round(var_pop(l_quantity), 4) AS variance, round(stddev_pop(l_quantity), 4) AS std,
           median(l_quantity) AS median, min(l_quantity) AS least, max(l_quantity) AS most,
           count(*) FILTER (WHERE l_discount > 0.05) AS discounted
    FROM lineitem GROUP BY l_suppkey
    """,
)
def group_stats(spark, sf_dir):
    """Population variance and deviation, exact median, extremes and a conditional count per supplier."""
    q = F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.count("*").alias("n"),
            F.round(stats.variance(q), 4).alias("variance"),
            F.round(stats.std(q), 4).alias("std"),
            stats.median(q).alias("median"),
            F.min(q).alias("least"),
            F.max(q).alias("most"),
            stats.count(F.col("l_discount") > 0.05).alias("discounted"),
        )
    )


@_R.add(
    "q_strict_empty",
    "SELECT 0.0::DOUBLE AS total, 1.0::DOUBLE AS product, 'NaN'::DOUBLE AS mean, NULL::DOUBLE AS least",
)
def strict_empty(spark, sf_dir):
    """What strict aggregates make of no rows."""
    q = F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .filter(q < 0)
        .agg(
            stats.total(q, strict=True).alias("total"),
            stats.product(q, strict=True).alias("product"),
            stats.mean(q, strict=True).alias("mean"),
            F.min(q).alias("least"),
        )
    )


@_R.add(
    "q_argmin_first",
    """
    SELECT p_brand, p_partkey AS cheapest, p_retailprice AS price FROM (
        SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS n FROM part) WHERE n = 1
    """,
)
def argmin_first(spark, sf_dir):
    """The cheapest part of each brand, the first among equals."""
    k = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part")
        .groupBy("p_brand")
        .agg(stats.argmin_first(k, F.col("p_retailprice"), k).alias("cheapest"), F.min("p_retailprice").alias("price"))
    )


@_R.add(
    "q_argmax_first",
    """
    SELECT p_brand, p_partkey AS largest, p_size AS size FROM (
        SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n = 1
    """,
)
def argmax_first(spark, sf_dir):
    """The largest part of each brand, the first among equals."""
    k = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part")
        .groupBy("p_brand")
        .agg(stats.argmax_first(k, F.col("p_size"), k).alias("largest"), F.max("p_size").alias("size"))
    )


@_R.add(
    "q_mean_instant",
    "SELECT event_type, epoch_us(ts_mean) // 1000 AS mean_ms FROM (SELECT event_type, make_timestamp((sum(epoch_us(ts)::HUGEINT) // count(*))::BIGINT) AS ts_mean FROM events GROUP BY 1)",
)
def mean_instant(spark, sf_dir):
    """The mean of timestamps, which have no sum: whole microseconds, summed as decimals."""
    us = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.floor(F.floor(F.sum(us) / F.count("*")) / 1000).cast("long").alias("mean_ms"))


_SETS = "round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY"


def _levels(grouped):
    return grouped.agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"))


@_R.add("q_rollup", f"SELECT l_returnflag, l_linestatus, {_SETS} ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return _levels(table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus"))


@_R.add("q_cube", f"SELECT l_returnflag, l_linestatus, {_SETS} CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return _levels(table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus"))


@_R.add("q_grouping_sets", f"SELECT l_returnflag, l_linestatus, {_SETS} GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")], []]
    return _levels(table(spark, sf_dir, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus"))


@_R.add(
    "q_pivot",
    """
    SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_linestatus = 'F') AS filled
    FROM lineitem GROUP BY 1
    """,
)
def pivot(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1)))
    return lines.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("open"), F.coalesce("F", F.lit(0)).alias("filled"))


@_R.add(
    "q_collected",
    """
    SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY o_orderkey), '|') AS priorities, count(*) AS n
    FROM orders GROUP BY 1
    """,
)
def collected(spark, sf_dir):
    """Each customer's orders gathered in order: groups as small sub-collections."""
    found = table(spark, sf_dir, "orders").groupBy("o_custkey")
    return found.agg(F.array_join(stats.collected(F.col("o_orderpriority"), F.col("o_orderkey")), "|").alias("priorities"), F.count("*").alias("n"))
