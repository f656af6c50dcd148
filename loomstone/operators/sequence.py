"""Operators on ordered rows.

DataFrames have no order, so each operator takes one: ``order``, a list of columns that together decide it. With
``by`` the rows of each group are a sequence of their own, and a window over the group does the work. Without it, the
whole table is one sequence; ``indexed`` and what is made from it then number the rows over ranges of the order, so that no
task holds them all, and the others refuse.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomstone.session import cut

Names = Sequence[str]


def _window(order: Names, by: Names) -> WindowSpec:
    if not by:
        raise ValueError("a window over a whole table is one task: name the columns of a group, or use indexed, batched or trace_sum")
    return Window.partitionBy(*by).orderBy(*order)


def fresh(df: DataFrame | Names, *stems: str) -> list[str]:
    """A name for each stem that no column has, upper and lower case alike."""
    taken, out = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}, []
    for stem in stems:
        while stem.lower() in taken:
            stem = f"_{stem}"
        taken.add(stem.lower())
        out.append(stem)
    return out


def _fresh(df: DataFrame, stem: str) -> str:
    return fresh(df, stem)[0]


def indexed(df: DataFrame, order: Names, by: Names = (), out: str = "index") -> DataFrame:
    """``df`` with ``out``: each row's place in the order, from 0.

    Without ``by`` the rows are dealt by ranges of the order and sorted where they are; a place is the number of rows in
    the ranges below plus the place in the range. Only a count per range goes to every task.
    """
    if by:
        return df.withColumn(out, (F.row_number().over(_window(order, by)) - 1).cast("long"))
    part, local = _fresh(df, "part"), _fresh(df, "local")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Numbers within a partition are the low 33 bits of the ids; ranges are fixed by the checkpoint.
    ids = F.monotonically_increasing_id()
    dealt = cut(dealt.withColumn(local, ids).withColumn(part, F.shiftright(local, 33)).withColumn(local, F.col(local).bitwiseAND(F.lit((1 << 33) - 1))))
    counts = dealt.groupBy(part).agg(F.count("*").alias("n"))
    bases = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("base"))
    return dealt.join(F.broadcast(bases), part).withColumn(out, F.col("base") + F.col(local)).drop(part, local, "base")


def zip_rows(left: DataFrame, right: DataFrame, left_order: Names, right_order: Names) -> DataFrame:
    """Rows side by side by their place, as many as the shorter table has; column names must differ."""
    i = "place_"
    while i in left.columns or i in right.columns:
        i = f"_{i}"
    return indexed(left, left_order, out=i).join(indexed(right, right_order, out=i), i).drop(i)


def weave(left: DataFrame, right: DataFrame, left_order: Names, right_order: Names, out: str = "index") -> DataFrame:
    """The rows of two tables with the same columns in turn, to the length of the shorter, with their place."""
    a, b = indexed(left, left_order, out=out), indexed(right, right_order, out=out)
    n = a.agg(F.count("*").alias("n")).unionAll(b.agg(F.count("*").alias("n"))).agg(F.min("n").alias("n"))
    both = a.withColumn(out, 2 * F.col(out)).unionByName(b.withColumn(out, 2 * F.col(out) + 1))
    size = _fresh(both, "n_")
    return both.join(F.broadcast(n.withColumnRenamed("n", size)), F.col(out) < 2 * F.col(size)).drop(size)


def first_only(df: DataFrame, keys: Names, order: Names) -> DataFrame:
    """The first row of each key."""
    n = _fresh(df, "n_")
    return df.withColumn(n, F.row_number().over(_window(order, keys))).filter(F.col(n) == 1).drop(n)


def last_only(df: DataFrame, keys: Names, order: Names) -> DataFrame:
    """The last row of each key: an index in which the last value wins."""
    n = _fresh(df, "n_")
    reverse = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn(n, F.row_number().over(reverse)).filter(F.col(n) == 1).drop(n)


def run_number(df: DataFrame, key: Column, order: Names, by: Names, out: str = "run") -> DataFrame:
    """``df`` with ``out``: the number, from 0, of the maximal run of rows with equal ``key``; nulls are equal."""
    w = _window(order, by)
    k = _fresh(df, "key_")
    same = F.col(k).eqNullSafe(F.lag(k).over(w)) & (F.row_number().over(w) > 1)
    flag = _fresh(df, "new_")
    keyed = df.withColumn(k, key)
    return keyed.withColumn(flag, F.when(same, 0).otherwise(1)).withColumn(out, F.sum(flag).over(w) - 1).drop(flag, k)


def runs(df: DataFrame, key: Column, order: Names, by: Names) -> DataFrame:
    """(by.., run, key, length) of each maximal run."""
    k = _fresh(df, "key")
    numbered = run_number(df.withColumn(k, key), F.col(k), order, by)
    return numbered.groupBy(*by, "run").agg(F.first(k).alias("key"), F.count("*").alias("length"))


def longest_train(df: DataFrame, p: Column, order: Names, by: Names) -> DataFrame:
    """(by.., start, length) of the first longest run of rows that satisfy ``p``; start counts from 0."""
    flag, place = _fresh(df, "flag_"), _fresh(df, "place_")
    marked = indexed(df.withColumn(flag, F.coalesce(p, F.lit(False))), order, by, place)
    numbered = run_number(marked, F.col(flag), order, by).filter(F.col(flag))
    trains = numbered.groupBy(*by, "run").agg(F.min(place).alias("start"), F.count("*").alias("length"))
    best = F.max(F.struct(F.col("length"), (-F.col("start")).alias("s"))).alias("b")
    return trains.groupBy(*by).agg(best).select(*by, (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"))


def trace(df: DataFrame, value: Column, order: Names, by: Names, f: Callable[[Column], Column] = F.sum, out: str = "state") -> DataFrame:
    """``df`` with the running state of an aggregate function, the row's own value included."""
    return df.withColumn(out, f(value).over(_window(order, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def trace_sum(df: DataFrame, value: Column, order: Names, out: str = "state", block: int = 100_000) -> DataFrame:
    """The running sum over a whole table: within blocks of the order, plus the sums of the blocks before."""
    i, b, v = _fresh(df, "place_"), _fresh(df, "block_"), _fresh(df, "value_")
    placed = indexed(df.withColumn(v, value), order, out=i).withColumn(b, F.floor(F.col(i) / block))
    sums = placed.groupBy(b).agg(F.sum(v).alias("s"))
    before = sums.select(b, (F.sum("s").over(Window.orderBy(b)) - F.col("s")).alias("base_"))
    inside = F.sum(v).over(Window.partitionBy(b).orderBy(i))
    return placed.join(before, b).withColumn(out, F.coalesce(F.col("base_"), F.lit(0)) + inside).drop(i, b, v, "base_")


def batched(df: DataFrame, n: int, order: Names, by: Names = (), out: str = "batch") -> DataFrame:
    """``df`` with ``out``: the number of the row's batch of ``n``."""
    return indexed(df, order, by, out).withColumn(out, F.floor(F.col(out) / n))


def slide(df: DataFrame, n: int, value: Column, order: Names, by: Names, out: str = "window") -> DataFrame:
    """A row for each window of exactly ``n`` rows, at its first, with the values as an array."""
    values = F.collect_list(value).over(_window(order, by).rowsBetween(0, n - 1))
    whole = F.count(F.lit(1)).over(_window(order, by).rowsBetween(0, n - 1)) == n
    flag = _fresh(df, "whole_")
    return df.withColumns({out: values, flag: whole}).filter(flag).drop(flag)


def _still(p: Column, order: Names, by: Names, first: bool = True) -> Column:
    ok = F.when(F.coalesce(p, F.lit(False)), 1).otherwise(0)
    w = _window(order if first else [F.desc(c) for c in order], by)
    return F.min(ok).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1


def span(df: DataFrame, p: Column, order: Names, by: Names, out: str = "inside") -> DataFrame:
    """``df`` with ``out``: whether the row is in the longest leading run that satisfies ``p``."""
    return df.withColumn(out, _still(p, order, by))


def keep_while(df: DataFrame, p: Column, order: Names, by: Names, trailing: bool = False) -> DataFrame:
    """The longest leading run that satisfies ``p``, or the trailing one."""
    flag = _fresh(df, "inside_")
    return df.withColumn(flag, _still(p, order, by, not trailing)).filter(flag).drop(flag)


def skip_while(df: DataFrame, p: Column, order: Names, by: Names, trailing: bool = False) -> DataFrame:
    """What follows the longest leading run that satisfies ``p``, or precedes the trailing one."""
    flag = _fresh(df, "inside_")
    return df.withColumn(flag, _still(p, order, by, not trailing)).filter(~F.col(flag)).drop(flag)


def excerpt(df: DataFrame, start: int, stop: int, order: Names, by: Names = ()) -> DataFrame:
    """The rows whose places are in [start, stop)."""
    i = _fresh(df, "place_")
    return indexed(df, order, by, i).filter((F.col(i) >= start) & (F.col(i) < stop)).drop(i)


def keep(df: DataFrame, n: int, order: Names, last: bool = False) -> DataFrame:
    """The first or the last ``n`` rows of a table, found without a full sort."""
    return df.orderBy(*[F.desc(c) if last else F.asc(c) for c in order]).limit(n)


def skip(df: DataFrame, n: int, order: Names) -> DataFrame:
    """All but the first ``n`` rows of a table."""
    i = _fresh(df, "place_")
    return indexed(df, order, out=i).filter(F.col(i) >= n).drop(i)


def seek(df: DataFrame, p: Column, order: Names) -> DataFrame:
    """The first row that satisfies ``p``, or none."""
    return df.filter(p).orderBy(*order).limit(1)


def partition(df: DataFrame, p: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that satisfy ``p``, and all others, those with a null verdict included."""
    sure = F.coalesce(p, F.lit(False))
    return df.filter(sure), df.filter(~sure)


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, k: int, by: Names, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1; Spark keeps k rows a group before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """A random order that is the same for the same rows, seed and partitions."""
    return df.orderBy(F.rand(seed))
