"""Connected components by rounds of large-star and small-star, on links only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.session import cut


#: Links that one task reads; few links are read by few tasks, whatever the session's number of partitions.
TASK_LINKS = 50_000


def _cut(links: DataFrame, n: int) -> DataFrame:
    """``links``, about ``n``, written to the shared folder and read in as many tasks as they need."""
    return cut(links).coalesce(n // TASK_LINKS + 1)


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star round on undirected (src, dst), src > dst: each vertex passes the least of its neighbours on.

    The least are cut off before the join, so that both its sides are dealt anew and a vertex with very many
    neighbours can be split over tasks; neither is broadcast, for the driver would hold what each round sends.
    """
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    least = _cut(both.groupBy("src").agg(F.min("dst").alias("m")), n)
    out = both.join(least.hint("merge"), "src").select("src", "dst", F.least("src", "m").alias("m"))
    if large:
        return out.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
    own = out.filter(F.col("dst") != F.col("m")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return own.unionByName(out.select("src", F.col("m").alias("dst"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal links."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) for every row of ``vertices`` (id): the least id that ``links`` (src, dst) reach from it.

    The rounds end when the links are stars around their least vertex; each is written to the shared folder, so that
    neither plan nor recovery grows with their number.
    """
    edges = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src != dst").distinct()
    edges = cut(edges)
    before, state = None, _digest(edges)
    while state[0] and state != before:
        n = state[0]
        edges = _cut(_star(_cut(_star(edges.coalesce(n // TASK_LINKS + 1), True, n), n), False, n), n)
        before, state = state, _digest(edges)
    named = edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).hint("merge")
    return vertices.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
