"""Totals and statistics as aggregate columns, with SQL's or the strict meaning of nothing.

By default an aggregate over no rows is null. With ``strict`` an empty total is 0, an empty product 1 and an empty mean NaN.
Variance and deviation are those of the population.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column, strict: bool = False) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)) if strict else F.sum(x)


def product(x: Column, strict: bool = False) -> Column:
    return F.coalesce(F.product(x), F.lit(1.0)) if strict else F.product(x)


def mean(x: Column, strict: bool = False) -> Column:
    return F.coalesce(F.avg(x), F.lit(float("nan"))) if strict else F.avg(x)


def mean_instant(x: Column) -> Column:
    """The mean of timestamps."""
    return F.timestamp_micros(F.avg(F.unix_micros(x)).cast("long"))


def variance(x: Column) -> Column:
    return F.var_pop(x)


def std(x: Column) -> Column:
    return F.stddev_pop(x)


def median(x: Column) -> Column:
    """The exact median, the mean of the two middle values of an even number."""
    return F.median(x)


def count(p: Column) -> Column:
    """How many rows satisfy ``p``."""
    return F.count_if(p)


def argmin_first(x: Column, key: Column, order: Column) -> Column:
    """``x`` of the row with the least ``key``, the first in ``order`` among equals."""
    return F.min_by(x, F.when(key.isNotNull(), F.struct(key, order)))


def argmax_first(x: Column, key: Column, order: Column) -> Column:
    """``x`` of the row with the greatest ``key``, the first in a numeric ``order`` among equals."""
    return F.max_by(x, F.when(key.isNotNull(), F.struct(key, -order)))


def first_in(x: Column, order: Column) -> Column:
    return F.min_by(x, order)


def last_in(x: Column, order: Column) -> Column:
    return F.max_by(x, order)


def collected(x: Column, order: Column) -> Column:
    """The values of a group in order, as an array; for groups of a bounded size."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), lambda s: s["x"])
