"""Ordered collections as array and map columns: positional, prefix and run operators.

Positions count from 0. Every function is a Column expression that stays in the JVM; a null collection gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]


def slice_between(a: Column, start: Column | int, stop: Column | int) -> Column:
    """Elements from ``start`` up to ``stop``, both clamped to the array; empty where they cross."""
    n = F.size(a)
    lo = F.greatest(F.lit(0), F.least(n, _int(start)))
    hi = F.greatest(lo, F.least(n, _int(stop)))
    return F.slice(a, lo + 1, hi - lo)


def _int(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x.cast("int")


def _held(a: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the array, which is reckoned once however often ``f`` names it."""
    return F.get(F.transform(F.array(a), f), F.lit(0))


def excerpt(a: Column, start: Column | int, stop: Column | int) -> Column:
    """The segment [start, stop); never an error."""
    return slice_between(a, start, stop)


def keep(a: Column, n: Column | int, right: bool = False) -> Column:
    """The first ``n`` elements, or the last."""
    n = _int(n)
    return slice_between(a, F.size(a) - n, F.size(a)) if right else slice_between(a, 0, n)


def skip(a: Column, n: Column | int, right: bool = False) -> Column:
    """All but the first ``n`` elements, or but the last."""
    n = _int(n)
    return slice_between(a, 0, F.size(a) - n) if right else slice_between(a, n, F.size(a))


def snip(a: Column, n: Column | int) -> Column:
    """The array parted at ``n``: struct(left, right)."""
    return F.struct(keep(a, n).alias("left"), skip(a, n).alias("right"))


def before(a: Column, i: Column | int) -> Column:
    """The segment strictly before position ``i``."""
    return slice_between(a, 0, i)


def upto(a: Column, i: Column | int) -> Column:
    """The segment up to position ``i``, which it includes."""
    return slice_between(a, 0, _int(i) + 1)


def from_(a: Column, i: Column | int) -> Column:
    """The segment from position ``i`` to the end."""
    return slice_between(a, i, F.size(a))


def after(a: Column, i: Column | int) -> Column:
    """The segment strictly after position ``i``."""
    return slice_between(a, _int(i) + 1, F.size(a))


def where(a: Column, p: Predicate) -> Column:
    """The position of the first element that satisfies ``p``, or null; a null verdict is no match."""
    at = F.array_position(F.transform(a, lambda x: F.coalesce(p(x), F.lit(False))), True)
    return F.nullif(at, F.lit(0)) - 1


def seek(a: Column, p: Predicate) -> Column:
    """The first element that satisfies ``p``, or null."""
    return F.get(F.filter(a, p), F.lit(0))


def before_match(a: Column, p: Predicate) -> Column:
    """All before the first match; without one, all but the last element."""
    return before(a, F.coalesce(where(a, p), F.size(a) - 1))


def upto_match(a: Column, p: Predicate) -> Column:
    """All up to and with the first match; without one, the whole array."""
    return upto(a, F.coalesce(where(a, p), F.size(a) - 1))


def snip_match(a: Column, p: Predicate) -> Column:
    """The array parted before the first match; null without one."""
    at = where(a, p)
    return F.when(at.isNotNull(), F.struct(before(a, at).alias("left"), from_(a, at).alias("right")))


def keep_while(a: Column, p: Predicate, right: bool = False) -> Column:
    """The longest leading run that satisfies ``p``, or the longest trailing one."""
    if right:
        return F.reverse(keep_while(F.reverse(a), p))
    return keep(a, F.coalesce(where(a, lambda x: ~F.coalesce(p(x), F.lit(False))), F.size(a)))


def skip_while(a: Column, p: Predicate, right: bool = False) -> Column:
    """What follows the longest leading run that satisfies ``p``, or precedes the trailing one."""
    if right:
        return F.reverse(skip_while(F.reverse(a), p))
    return skip(a, F.coalesce(where(a, lambda x: ~F.coalesce(p(x), F.lit(False))), F.size(a)))


def span(a: Column, p: Predicate) -> Column:
    """struct(left, right): the longest leading run that satisfies ``p``, and the rest."""
    return F.struct(keep_while(a, p).alias("left"), skip_while(a, p).alias("right"))


def all_(a: Column, p: Predicate) -> Column:
    """Whether every element satisfies ``p``; true of an empty array."""
    return F.forall(a, p)


def count(a: Column, p: Predicate) -> Column:
    """How many elements satisfy ``p``."""
    return F.size(F.filter(a, p))


def partition(a: Column, p: Predicate) -> Column:
    """struct(yes, no): the elements that satisfy ``p`` and those that do not, nulls among the latter."""
    sure = lambda x: F.coalesce(p(x), F.lit(False))
    return F.struct(F.filter(a, sure).alias("yes"), F.filter(a, lambda x: ~sure(x)).alias("no"))


def unique(a: Column) -> Column:
    """The element of an array of one, else null."""
    return F.when(F.size(a) == 1, F.get(a, F.lit(0)))


def occupied(a: Column) -> Column:
    """The array unless it is empty, else null."""
    return F.when(F.size(a) > 0, a)


def sweep(a: Column, p: Predicate, f: Callable[[Column], Column]) -> Column:
    """``f`` of the elements that satisfy ``p``."""
    return F.transform(F.filter(a, p), f)


def sift(a: Column, kind: str) -> Column:
    """Elements of a VARIANT array that are of the kind that ``schema_of_variant`` names."""
    return F.filter(a, lambda v: F.schema_of_variant(v) == kind)


def subsumes(a: Column, part: Column) -> Column:
    """Whether ``part`` is a contiguous run of ``a``; an empty part always is."""
    n, m = F.size(a), F.size(part)
    starts = F.sequence(F.lit(0), F.greatest(n - m, F.lit(0)))
    return F.when(m == 0, F.lit(True)).when(m > n, F.lit(False)).otherwise(F.exists(starts, lambda i: F.slice(a, i + 1, m) == part))


def zip_(a: Column, b: Column) -> Column:
    """Pairs struct(left, right) by position, as many as the shorter array has."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(keep(a, n), keep(b, n), lambda x, y: F.struct(x.alias("left"), y.alias("right")))


def weave(a: Column, b: Column) -> Column:
    """The arrays' elements in turn, to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.flatten(F.zip_with(keep(a, n), keep(b, n), lambda x, y: F.array(x, y)))


def indexed(a: Column) -> Column:
    """struct(index, value) for each element."""
    return F.transform(a, lambda x, i: F.struct(i.alias("index"), x.alias("value")))


def intercalate(a: Column, separator: Column) -> Column:
    """An array of arrays laid end to end with ``separator``, an array, between them."""
    return F.flatten(F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(F.concat(separator, x))))


def batched(a: Column, n: int) -> Column:
    """Consecutive batches of ``n`` elements; the last may be shorter."""
    starts = F.sequence(F.lit(0), F.size(a) - 1, F.lit(n))
    return F.when(F.size(a) == 0, F.slice(F.array(a), 1, 0)).otherwise(F.transform(starts, lambda i: F.slice(a, i + 1, F.lit(n))))


def slide(a: Column, n: int) -> Column:
    """All windows of exactly ``n`` consecutive elements."""
    starts = F.sequence(F.lit(0), F.size(a) - n)
    return F.when(F.size(a) < n, F.slice(F.array(a), 1, 0)).otherwise(F.transform(starts, lambda i: F.slice(a, i + 1, F.lit(n))))


def runs(a: Column) -> Column:
    """Maximal runs of equal neighbours, as arrays; nulls are equal."""

    def cut(a: Column) -> Column:
        n = F.size(a)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))
        ends = F.concat(skip(begins, 1), F.array(n))
        found = F.zip_with(begins, ends, lambda b, e: F.slice(a, b + 1, e - b))
        return F.when(n == 0, F.slice(F.array(a), 1, 0)).otherwise(found)

    return _held(a, cut)


def trace(a: Column, zero: Column, f: Callable[[Column, Column], Column]) -> Column:
    """All states of a left fold, the first included.

    An array that grows is copied at each step, so that the states at the bounds of blocks, as many as each has elements,
    come first and those within each block next: the copies grow with the length to the power of 1.5.
    """

    def states(a: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), width)
        block = lambda i: F.slice(a, i + 1, width)
        bounds = F.aggregate(starts, F.array(zero), lambda s, i: F.concat(s, F.array(F.aggregate(block(i), F.element_at(s, -1), f))))
        whole = lambda i, first: F.aggregate(block(i), F.array(first), lambda s, x: F.concat(s, F.array(f(F.element_at(s, -1), x))))
        rest = F.zip_with(starts, keep(bounds, F.size(starts)), lambda i, first: skip(whole(i, first), 1))
        return F.concat(F.array(zero), F.flatten(rest))

    return _held(a, states)


def fold(a: Column, zero: Column, f: Callable[[Column, Column], Column], right: bool = False) -> Column:
    """The left fold, or the right one."""
    return F.aggregate(F.reverse(a) if right else a, zero, f)


def distinct(a: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(a)


def define(a: Column, i: int, value: Column) -> Column:
    """The array with element ``i`` replaced; unchanged where there is none."""
    return F.transform(a, lambda x, k: F.when(k == i, value).otherwise(x))


def unwind(a: Column, tail: Column) -> Column:
    """``a`` reversed, then ``tail``."""
    return F.concat(F.reverse(a), tail)


def sequence_all(a: Column) -> Column:
    """The array where no element is null, else null."""
    return F.when(~F.exists(a, lambda x: x.isNull()), a)


def traverse(a: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of every element, or null where any of these is null."""
    return sequence_all(F.transform(a, f))


def sort_by(a: Column, key: Callable[[Column], Column]) -> Column:
    """Stable sort by a key."""
    keyed = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def permute(a: Column, order: Column) -> Column:
    """Element ``order[k]`` at each place k."""
    return F.transform(order, lambda i: F.get(a, i))


def permutation_rank(order: Column) -> Column:
    """The place of a permutation of 0 .. n-1 among all in lexicographic order; up to 20 elements."""
    n = F.size(order)
    smaller = lambda x, i: F.size(F.filter(slice_between(order, i + 1, n), lambda y: y < x))
    terms = F.transform(order, lambda x, i: smaller(x, i).cast("long") * F.factorial(n - 1 - i))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + t)


# Maps


def collate(a: Column, b: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The maps as one; where both have a key, ``merge`` of its values."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(merge(x, y)))


def map_union(a: Column, b: Column) -> Column:
    """The maps as one; the right value wins."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def upsert(m: Column, key: Column, f: Callable[[Column], Column]) -> Column:
    """The map with ``f`` of the old value, null if there is none, at ``key``."""
    return map_union(m, F.create_map(key, f(F.try_element_at(m, key))))


def removed(m: Column, key: Column) -> Column:
    """The map without ``key``."""
    return F.map_filter(m, lambda k, v: k != key)


def plus(m: Column, key: Column, value: Column) -> Column:
    """A map of arrays with ``value`` before those at ``key``."""
    old = F.try_element_at(m, key)
    return map_union(m, F.create_map(key, F.when(old.isNull(), F.array(value)).otherwise(F.concat(F.array(value), old))))


def index_by(a: Column, key: Callable[[Column], Column]) -> Column:
    """A map from ``key`` of each element to the element; the last of a key wins."""
    keyed = F.transform(a, lambda x: F.struct(key(x).alias("key"), x.alias("value")))
    last = F.filter(keyed, lambda e, i: ~F.exists(slice_between(keyed, i + 1, F.size(keyed)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def permutation(rank: Column, n: int) -> Column:
    """The permutation of 0 .. n-1 at a place in lexicographic order; n is at most 20.

    All of them are ``spark.range(factorial(n))`` with this column.
    """
    zero = F.struct(F.array().cast("array<int>").alias("taken"), F.array(*map(F.lit, range(n))).alias("left"), rank.cast("long").alias("rest"))

    def step(s: Column, k: Column) -> Column:
        block = F.factorial(F.lit(n - 1) - k)
        i = F.floor(s["rest"] / block).cast("int")
        x = F.get(s["left"], i)
        return F.struct(F.concat(s["taken"], F.array(x)).alias("taken"), F.array_remove(s["left"], x).alias("left"), F.pmod(s["rest"], block).alias("rest"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), zero, step, lambda s: s["taken"])
