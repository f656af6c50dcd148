"""Queries over graphs and partial orders derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import graph as G
from loomstone.plans.registry import Registry, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

# Sizes of parts under divisibility: an edge from a size to twice, thrice and five times it, where there are such parts.
_S = "s AS (SELECT DISTINCT p_size AS s FROM part), e AS (SELECT a.s AS src, b.s AS dst FROM s a, (SELECT unnest([2, 3, 5]) AS f), s b WHERE b.s = a.s * f)"


def _edges(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    factors = F.explode(F.array(F.lit(2), F.lit(3), F.lit(5)))
    multiples = sizes.select(F.col("p_size").alias("src"), factors.alias("f")).select("src", (F.col("src") * F.col("f")).alias("dst"))
    return multiples.join(sizes.withColumnRenamed("p_size", "dst"), "dst", "left_semi").select("src", "dst")


_REC = f"WITH RECURSIVE {_S}, c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"


@_R.add("q_closure", f"{_REC} SELECT src, dst FROM c")
def closure(spark, sf_dir):
    return G.closure(_edges(spark, sf_dir))


@_R.add(
    "q_topo",
    f"""
    WITH RECURSIVE {_S}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
    p(id, n) AS (SELECT id, 0 FROM v UNION SELECT e.src, p.n + 1 FROM p JOIN e ON e.dst = p.id)
    SELECT id, max(n)::INT AS level FROM p GROUP BY 1
    """,
)
def topo(spark, sf_dir):
    return G.levels(_edges(spark, sf_dir))


@_R.add(
    "q_topo_place",
    f"""
    WITH RECURSIVE {_S}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
    p(id, n) AS (SELECT id, 0 FROM v UNION SELECT e.src, p.n + 1 FROM p JOIN e ON e.dst = p.id),
    l AS (SELECT id, max(n) AS n FROM p GROUP BY 1)
    SELECT id, row_number() OVER (ORDER BY n, id) - 1 AS place FROM l
    """,
)
def topo_place(spark, sf_dir):
    return G.topological(_edges(spark, sf_dir))


@_R.add(
    "q_reduction",
    f"{_REC} SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e f JOIN c ON f.dst = c.src WHERE f.src = e.src AND c.dst = e.dst)",
)
def reduction(spark, sf_dir):
    """The steps that remain of the whole closure's edges."""
    return G.reduction(G.closure(_edges(spark, sf_dir)))


@_R.add("q_ancestors", f"{_REC} SELECT src, dst FROM e WHERE dst = 24 OR dst IN (SELECT src FROM c WHERE dst = 24)")
def ancestors(spark, sf_dir):
    return G.ancestors(_edges(spark, sf_dir), spark.sql("SELECT 24 AS id"))


@_R.add("q_descendants", f"{_REC} SELECT src, dst FROM e WHERE src = 3 OR src IN (SELECT dst FROM c WHERE src = 3)")
def descendants(spark, sf_dir):
    return G.descendants(_edges(spark, sf_dir), spark.sql("SELECT 3 AS id"))


@_R.add("q_reachable", f"{_REC} SELECT 7 AS src, 7 AS dst UNION SELECT src, dst FROM c WHERE src = 7")
def reachable(spark, sf_dir):
    return G.reachable(_edges(spark, sf_dir), spark.sql("SELECT 7 AS id"))


@_R.add(
    "q_keep_vertices",
    f"""
    {_REC.replace('c(src, dst) AS', 'b(src, dst) AS (SELECT src, dst FROM e WHERE src % 2 = 1 OR src % 4 = 0 UNION SELECT b.src, e.dst FROM b JOIN e ON b.dst = e.src AND b.dst % 4 = 2), c(src, dst) AS')}
    SELECT src, dst FROM b WHERE (src % 2 = 1 OR src % 4 = 0) AND dst % 4 <> 2
    """,
)
def keep_vertices(spark, sf_dir):
    """The graph without the sizes that leave two by four, their neighbours bridged."""
    edges = _edges(spark, sf_dir)
    return G.keep_vertices(edges, G.vertices(edges).filter("id % 4 != 2"))


@_R.add(
    "q_hasse",
    """
    WITH s AS (SELECT DISTINCT p_size AS s FROM part), o AS (SELECT a.s AS low, b.s AS high FROM s a, s b WHERE a.s < b.s AND b.s % a.s = 0)
    SELECT low, high FROM o WHERE NOT EXISTS (SELECT 1 FROM o x JOIN o y ON x.high = y.low WHERE x.low = o.low AND y.high = o.high)
    """,
)
def hasse(spark, sf_dir):
    """The covering pairs of divisibility; each size's multiples are listed, not all pairs tried."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("low")).distinct()
    most = sizes.agg(F.max("low").alias("m"))
    multiples = F.when(F.col("low") * 2 <= F.col("m"), F.sequence(F.col("low") * 2, F.col("m"), F.col("low")))
    pairs = sizes.join(F.broadcast(most)).select("low", F.explode(multiples).alias("high"))
    return G.covers(pairs.join(sizes.withColumnRenamed("low", "high"), "high", "left_semi").select("low", "high"))


@_R.add(
    "q_extrema",
    f"WITH {_S}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, 'max' AS kind FROM v WHERE id NOT IN (SELECT src FROM e) UNION ALL SELECT id, 'min' FROM v WHERE id NOT IN (SELECT dst FROM e)",
)
def extrema(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    order = edges.select(F.col("src").alias("low"), F.col("dst").alias("high"))
    v = G.vertices(edges)
    return G.maxima(v, order).withColumn("kind", F.lit("max")).unionByName(G.minima(v, order).withColumn("kind", F.lit("min")))


@_R.add(
    "q_explore",
    f"""
    WITH RECURSIVE {_S}, p(id, n) AS (SELECT 1, 0 UNION SELECT e.dst, p.n + 1 FROM p JOIN e ON e.src = p.id WHERE n < 3)
    SELECT id, min(n)::INT AS depth FROM p GROUP BY 1
    """,
)
def explore(spark, sf_dir):
    return G.explore(spark.sql("SELECT 1 AS id"), _edges(spark, sf_dir), 3)


@_R.add("q_graph_dot", f"WITH {_S} SELECT '\"' || src || '\" -> \"' || dst || '\"' AS line FROM e")
def dot(spark, sf_dir):
    return G.dot(_edges(spark, sf_dir))
