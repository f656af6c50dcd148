"""Directed graphs as tables of edges (src, dst): src depends on dst.

Loops run on edges only, write each round to the shared folder, and stop when a round brings nothing new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import cut


class CyclicGraph(ValueError):
    """The graph has a cycle where none may be."""


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def invert(edges: DataFrame) -> DataFrame:
    """The edges turned about; all vertices stay."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def sources(edges: DataFrame) -> DataFrame:
    """Vertices without dependencies."""
    return vertices(edges).join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def _grow(start: DataFrame, edges: DataFrame) -> DataFrame:
    """All (src, dst) that ``start`` pairs reach by following further edges, those of ``start`` included."""
    steps = cut(edges.select("src", "dst").distinct())
    known = cut(start.select("src", "dst").distinct())
    front = known
    while not front.isEmpty():
        further = front.join(steps.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        front = cut(further.distinct().join(known, ["src", "dst"], "left_anti"))
        known = cut(known.unionByName(front))
    return known


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path from one to the other; a vertex on a cycle reaches itself."""
    return _grow(edges, edges)


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(src, dst): what each ``id`` of ``start`` reaches, itself included."""
    ids = start.select("id").distinct()
    first = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return _grow(first, edges)


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The edges among what ``start`` reaches."""
    ids = reachable(edges, start).select(F.col("dst").alias("src")).distinct()
    return edges.join(ids, "src", "left_semi")


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The edges among what reaches ``start``."""
    return invert(descendants(invert(edges), start))


def lineage(edges: DataFrame, start: DataFrame) -> DataFrame:
    return merge(ancestors(edges, start), descendants(edges, start))


def has_cycle(edges: DataFrame) -> bool:
    """Whether peeling vertices without dependencies leaves some."""
    try:
        levels(edges)
    except CyclicGraph:
        return True
    return False


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): the length of the longest path from each vertex to one without dependencies; refuses cycles.

    Peels level by level: a round removes the vertices all of whose dependencies are gone.
    """
    left = cut(edges.select("src", "dst").distinct())
    rest = cut(vertices(left))
    done, level = None, 0
    while True:
        free = cut(rest.join(left.select(F.col("src").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            if not rest.isEmpty():
                raise CyclicGraph("the graph has a cycle")
            return done if done is not None else free
        done = free if done is None else cut(done.unionByName(free))
        rest = cut(rest.join(free, "id", "left_anti"))
        left = cut(left.join(free.select(F.col("id").alias("dst")), "dst", "left_anti"))
        level += 1


def topological(edges: DataFrame) -> DataFrame:
    """(id, place): vertices after all that they depend on; of equals the lesser comes first."""
    found = levels(edges)
    inside = F.row_number().over(Window.partitionBy("level").orderBy("id"))
    sizes = found.groupBy("level").agg(F.count("*").alias("n"))
    before = sizes.select("level", (F.sum("n").over(Window.orderBy("level")) - F.col("n")).alias("base"))
    return found.join(F.broadcast(before), "level").select("id", (F.col("base") + inside - 1).alias("place"))


def reduction(edges: DataFrame) -> DataFrame:
    """The edges that no longer path implies, of a graph without cycles."""
    steps = edges.select("src", "dst").distinct()
    reach = closure(steps)
    implied = steps.select("src", F.col("dst").alias("mid")).join(reach.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
    return steps.join(implied.distinct(), ["src", "dst"], "left_anti")


def keep_vertices(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The graph on the ``id`` of ``kept``, with an edge where a path led through vertices that are gone."""
    ids = cut(kept.select("id").distinct())
    known = cut(edges.select("src", "dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))
    gone = edges.select("src", "dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    front = known
    while not front.isEmpty():
        further = front.join(gone.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        front = cut(further.distinct().join(known, ["src", "dst"], "left_anti"))
        known = cut(known.unionByName(front))
    return known.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def remove_vertex(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph without the ``id`` of ``gone``, its neighbours bridged."""
    return keep_vertices(edges, vertices(edges).join(gone.select("id"), "id", "left_anti"))


def explore(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of what is reached from ``start`` in at most ``depth`` steps, by the shortest way."""
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        near = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        front = cut(near.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def fold_up(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(id, total): each vertex's ``value`` and the totals of its dependencies, from the bottom up, a level at a time."""
    ranked = cut(levels(edges).join(values, "id", "left").withColumn("value", F.coalesce("value", F.lit(0))))
    most = ranked.agg(F.max("level")).first()[0]
    done = cut(ranked.filter("level = 0").select("id", F.col("value").alias("total")))
    for level in range(1, (most or 0) + 1):
        here = ranked.filter(F.col("level") == level)
        parts = edges.join(done.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("total").alias("below"))
        done = cut(done.unionByName(here.join(parts, "id").select("id", (F.col("value") + F.col("below")).alias("total"))))
    return done


def dot(edges: DataFrame) -> DataFrame:
    """One ``line`` of the DOT language per edge."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat_ws(" -> ", quoted("src"), quoted("dst")).alias("line"))


# Partial orders: tables of elements ``id`` with a relation (low, high) of all comparable pairs


def covers(order: DataFrame) -> DataFrame:
    """The pairs of a strict partial order with nothing between them."""
    between = order.select("low", F.col("high").alias("mid")).join(order.select(F.col("low").alias("mid"), "high"), "mid").select("low", "high")
    return order.join(between.distinct(), ["low", "high"], "left_anti")


def maxima(elements: DataFrame, order: DataFrame) -> DataFrame:
    return elements.join(order.select(F.col("low").alias("id")).distinct(), "id", "left_anti")


def minima(elements: DataFrame, order: DataFrame) -> DataFrame:
    return elements.join(order.select(F.col("high").alias("id")).distinct(), "id", "left_anti")


def with_bottom(elements: DataFrame, order: DataFrame, bottom) -> DataFrame:
    """The order with an element below all others."""
    return order.unionByName(elements.filter(F.col("id") != F.lit(bottom)).select(F.lit(bottom).alias("low"), F.col("id").alias("high"))).distinct()
