"""Joins, set operations, merging by key, intervals, and relation tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.sequence import fresh, indexed

Names = Sequence[str]


# Merging by key


def _same_key(key: Names, left: str, right: str) -> Column:
    """Keys agree, nulls among them equal."""
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def collate(left: DataFrame, right: DataFrame, key: Names, value: str, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """(key.., value) of either table; where both have a key, ``merge`` of its values. Null keys are keys like others."""
    side = lambda df: df.select(F.struct(*key).alias("k"), F.struct(F.col(value).alias("v")).alias("s"))
    both = side(left).alias("l").join(side(right).alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")), "full")
    a, b = F.col("l.s"), F.col("r.s")
    merged = F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(merge(a["v"], b["v"]))
    return both.select(F.coalesce("l.k", "r.k").alias("k"), merged.alias("v")).select(*[F.col("k")[c].alias(c) for c in key], F.col("v").alias(value))


def upsert(table: DataFrame, changes: DataFrame, key: Names) -> DataFrame:
    """``table`` with the rows of ``changes`` in the place of those with their key, null keys included, and besides them."""
    kept = table.alias("t").join(changes.select(*key).alias("c"), _same_key(key, "t", "c"), "left_anti")
    return kept.select(*table.columns).unionByName(changes.select(*table.columns))


def establish(table: DataFrame, wanted: DataFrame, key: Names, value: str, compute: Column) -> DataFrame:
    """``wanted`` with the value that ``table`` has for its key, null keys included, or else ``compute`` of the row."""
    v, = fresh(wanted, "established_")
    computed = wanted.drop(value).withColumn(v, compute).alias("w")
    joined = computed.join(table.select(*key, value).alias("t"), _same_key(key, "w", "t"), "left")
    return joined.select(*[F.col(f"w.{c}") for c in wanted.columns if c != value], F.coalesce(F.col(f"t.{value}"), F.col(f"w.{v}")).alias(value))


# Sets of rows


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


# Intervals


def range_join(left: DataFrame, right: DataFrame, left_start: str, left_finish: str, right_start: str, right_finish: str, width: float) -> DataFrame:
    """All pairs of rows whose half-open intervals of numbers overlap, with ``overlap_start`` and ``overlap_finish``.

    Each interval is noted in the bins of ``width`` that it meets, and pairs come from an equality join on the bin; a
    pair that shares several bins is formed in the bin where the overlap begins. ``width`` near the usual length of the
    intervals keeps both the notes and the bins small. Column names must differ.
    """
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))
    bin_, = fresh([*left.columns, *right.columns], "bin_")
    a = left.filter(F.col(left_start) < F.col(left_finish)).withColumn(bin_, F.explode(bins(left_start, left_finish)))
    b = right.filter(F.col(right_start) < F.col(right_finish)).withColumn(bin_, F.explode(bins(right_start, right_finish)))
    start, finish = F.greatest(left_start, right_start), F.least(left_finish, right_finish)
    return (
        a.join(b, bin_)
        .filter((start < finish) & (F.floor(start / width) == F.col(bin_)))
        .withColumns({"overlap_start": start, "overlap_finish": finish})
        .drop(bin_)
    )


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Names, forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with the columns of the nearest ``right`` row of its group at or before its time, or null.

    ``forward``: at or after it. ``strict``: not at it. The tables are laid into one, a window over the group in
    the order of time carries the last right row along, and no pair is formed. Of right rows with equal times one
    is taken. Column names other than ``by`` must differ.
    """
    others = [c for c in right.columns if c not in by]
    mark, time, carried = fresh([*left.columns, *right.columns], "right_", "time_", "carried_")
    row = F.struct(*others)
    a = left.withColumns({time: F.col(left_time), mark: F.lit(0), carried: F.lit(None).cast(right.select(row.alias("r")).schema[0].dataType)})
    b = right.select(*by, F.col(right_time).alias(time), F.lit(1).alias(mark), row.alias(carried))
    both = a.unionByName(b, allowMissingColumns=True)
    # Among equal times right rows come before left ones, or after them where equality does not count.
    tie = F.asc(mark) if strict else F.desc(mark)
    w = Window.partitionBy(*by).orderBy(F.desc(time) if forward else F.asc(time), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(carried, F.last(carried, ignorenulls=True).over(w)).filter(F.col(mark) == 0)
    return found.select(*left.columns, *[F.col(f"{carried}.{c}").alias(c) for c in others])


def merge_intervals(df: DataFrame, start: str, finish: str, by: Names) -> DataFrame:
    """(by.., start, finish) of the unions of overlapping half-open intervals; those that only touch stay apart."""
    w = Window.partitionBy(*by).orderBy(start, finish)
    reach = F.max(finish).over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = df.filter(F.col(start) < F.col(finish))
    flagged = live.withColumn("new_", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0))
    return (
        flagged.withColumn("island_", F.sum("new_").over(w))
        .groupBy(*by, "island_")
        .agg(F.min(start).alias(start), F.max(finish).alias(finish))
        .drop("island_")
    )


def skewed_join(big: DataFrame, small: DataFrame, on: Names, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equality join in which each key of ``big`` is dealt over ``salts`` tasks and ``small`` is repeated as often.

    ``how``: inner, left, left_semi or left_anti; a join that keeps rows of the repeated side would keep them as often. The
    salt is a hash of the row, so that a task that runs again deals its rows as before. The join is a merge, which spills: the
    planner reckons the repeated side as small as it was before, and a broadcast of it would lie whole in the driver and each task.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} keeps rows of the repeated side")
    salt, = fresh([*big.columns, *small.columns], "salt_")
    hashed = [f.name for f in big.schema if f.dataType.typeName() not in ("map", "variant")]
    salted = big.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    repeated = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*on, salt], how).drop(salt)


# Relation tables: interned values and pairs of references


def store(values: DataFrame, key: Names, out: str = "ref") -> DataFrame:
    """Each distinct value with a reference from 1, in the values' order."""
    return indexed(values.select(*key).distinct(), key, out=out).withColumn(out, F.col(out) + 1)


def reference(values: DataFrame, entities: DataFrame, key: Names, out: str = "ref") -> DataFrame:
    """``values`` with the reference of each; null where it is unknown."""
    return values.join(entities.select(*key, out), list(key), "left")


def dereference(refs: DataFrame, entities: DataFrame, ref: str = "ref") -> DataFrame:
    return refs.join(entities, ref)


def assign(relation: DataFrame, pairs: DataFrame) -> DataFrame:
    """The relation with more (left, right) pairs; each pair is there once."""
    return relation.unionByName(pairs).distinct()


def unassign(relation: DataFrame, pairs: DataFrame) -> DataFrame:
    return relation.join(pairs, ["left", "right"], "left_anti")


def lookup(relation: DataFrame, lefts: DataFrame, entities: DataFrame, ref: str = "ref") -> DataFrame:
    """The entities that the relation leads to from each ``left``; none for a left without a pair."""
    return lefts.select("left").distinct().join(relation, "left").join(entities, F.col("right") == F.col(ref)).drop("right")


# Comparison


def contrast(left: DataFrame, right: DataFrame, key: Names) -> DataFrame:
    """(key.., status, changed): each key's row is ``same``, ``different``, ``left`` or ``right`` only; ``changed`` names
    the columns that differ, nulls being equal."""
    others = [c for c in left.columns if c not in key]
    a = left.select(*key, F.struct(*others).alias("l_"))
    b = right.select(*key, F.struct(*others).alias("r_"))
    named = F.array(*[F.when(~F.col(f"l_.{c}").eqNullSafe(F.col(f"r_.{c}")), F.lit(c)) for c in others])
    changed = F.filter(named, lambda x: x.isNotNull())
    status = F.when(F.col("r_").isNull(), "left").when(F.col("l_").isNull(), "right").when(F.size(changed) == 0, "same").otherwise("different")
    both = a.join(b, list(key), "full")
    empty = F.array().cast("array<string>")
    return both.select(*key, status.alias("status"), F.when(status == "different", changed).otherwise(empty).alias("changed"))
