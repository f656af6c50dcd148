"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text is cut at blank lines into sections and at line feeds into paragraphs. A paragraph's digest is the MD5 of its text, a
section's that of its paragraphs' digests, and the root that of its sections' digests. Cutting loses nothing, so that roots are
equal where texts are, and going down from the roots past equal digests leads to the paragraphs that differ.

A fingerprint is ``root:section;section...`` with sections ``digest/paragraph,paragraph...`` and paragraphs ``digest.marks``.
Marks say how alike two paragraphs are: the heads of the MD5 of the paragraph's clauses, eight hex digits each, where a
clause ends after the white space that follows punctuation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import fresh, quoted

#: After one of these and white space a clause ends.
CLAUSE_END, MARK = r"([.!?,;:|&$%*#][ \t]+)", "\x01"
DIGITS = 8

_PLACE = "array<struct<section:int,paragraph:int>>"


def _md5(text: Column) -> Column:
    return F.md5(F.encode(text, "utf-8"))


def _heads(children: Column) -> Column:
    """The digests with which children begin, one after the other."""
    return F.array_join(F.transform(children, lambda c: F.left(c, F.lit(32))), "")


def _paragraph(text: Column) -> Column:
    clauses = F.split(F.regexp_replace(text, CLAUSE_END, "$1" + MARK), MARK, -1)
    return F.concat(_md5(text), F.lit("."), F.array_join(F.transform(clauses, lambda c: F.left(_md5(c), F.lit(DIGITS))), ""))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null is empty, and an empty text has one empty paragraph."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # A level is an array of one, so that what it holds is computed once and used twice.
    over = lambda children, sep, end: F.transform(
        F.array(children), lambda c: F.concat(_md5(_heads(c)), F.lit(end), F.array_join(c, sep))
    )[0]
    section = lambda s: over(F.transform(F.split(s, "\n", -1), _paragraph), ",", "/")
    return over(F.transform(F.split(text, "\n\n", -1), section), ";", ":")


def root(print_: Column) -> Column:
    """The root of a fingerprint."""
    return F.left(print_, F.lit(32))


def _marks(print_: Column) -> Column:
    """The distinct marks of a fingerprint: after each point, what goes on to the next paragraph or section."""
    each = F.regexp_replace(F.regexp_replace(print_, r"^[0-9a-f]{32}:", ";"), r"[;,](?:[0-9a-f]{32}/)?[0-9a-f]{32}\.", "")
    return F.array_distinct(F.regexp_extract_all(each, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """1 where the roots are equal; else less: the distinct marks that both have, over one more than those of the one that has
    more. The one more is the root."""
    x, y = _marks(a), _marks(b)
    shared = F.size(F.array_intersect(x, y)).cast("double")
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(shared / (F.greatest(F.size(x), F.size(y)) + 1))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """(section, paragraph), from 0, of each place at which the paragraphs of two fingerprints differ or only one has one.

    From the top down: where roots or sections agree, nothing below them is looked at.
    """
    tree = lambda p: F.split(F.substr(p, F.lit(34)), ";", -1)
    ours, theirs = tree(a), tree(b)
    head = lambda node: F.left(node, F.lit(32))
    paragraphs = lambda s: F.coalesce(F.split(F.substr(s, F.lit(34)), ",", -1), F.array().cast("array<string>"))
    places = lambda x, y: F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)

    def section(i: Column) -> Column:
        x, y = F.get(ours, i), F.get(theirs, i)
        p, q = paragraphs(x), paragraphs(y)
        differ = F.filter(places(p, q), lambda j: ~head(F.get(p, j)).eqNullSafe(head(F.get(q, j))))
        found = F.transform(differ, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
        return F.when(head(x).eqNullSafe(head(y)), F.array().cast(_PLACE)).otherwise(found)

    return F.when(root(a) == root(b), F.array().cast(_PLACE)).otherwise(F.flatten(F.transform(places(ours, theirs), section)))


def add_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with ``out``, each row's fingerprint; no rows move. Rows with one text have one fingerprint; a column
    of that name gives way. An empty table gives an empty table."""
    return docs.withColumn(out, fingerprint(quoted(text)))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the value; two short searches instead of one long."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda c: c <= value))
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    coarse = below(longs([c[0] for c in chunks]))
    fine = below(F.get(F.array(*map(longs, chunks)), coarse - 1))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)


def with_next(docs: DataFrame, order: str, carry: str, out: str, buckets: int | None = None) -> DataFrame:
    """``docs`` with ``out``: ``carry`` of the row with the next lower ``order``; the lowest row's is the highest's.

    The rows are dealt once, into buckets between approximate quantiles of the order, by default four for each
    partition that the session shuffles into; in a bucket a window looks one row ahead. A copy of the highest row
    of each bucket goes to the bucket above, to be the next of its lowest row; there are as many copies as buckets.

    ``order`` is a whole number. Rows that tie in it follow one another by the hash of ``carry``; null orders come
    last. A single row is its own next. An empty table stays empty. A column named ``out`` gives way.
    """
    spark = docs.sparkSession
    docs = docs.drop(out)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    o, b, ghost, tie, to = fresh(docs, "order_", "bucket_", "ghost_", "tie_", "to_")
    known = quoted(order).cast("long")
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    found = docs.agg(F.percentile_approx(known, shares, 10 * buckets).alias("c"), F.min(known).alias("least")).first()
    value = F.coalesce(known, F.lit((found.least or 0) - 1).cast("long"))
    keys = [value.alias(o), _bucket(value, sorted(set(found.c or []))).alias(b), F.xxhash64(quoted(carry)).alias(tie)]
    # One row per bucket: where a copy of its highest row goes.
    tops = docs.select(*keys).groupBy(b).agg(F.max(F.struct(o, tie)).alias("top")).select(b, f"top.{o}", f"top.{tie}")
    every = Window.orderBy(b)
    tops = tops.withColumn(to, F.coalesce(F.lead(b).over(every), F.first(b).over(every)))
    rows = docs.select("*", *keys).join(F.broadcast(tops), [b, o, tie], "left")
    copies = F.when(F.col(to).isNull(), F.array(F.col(b))).otherwise(F.array(b, to))
    placed = rows.select(*[quoted(c) for c in docs.columns], o, tie, F.posexplode(copies).alias(ghost, b))
    ahead = Window.partitionBy(b).orderBy(ghost, F.desc(o), F.desc(tie))
    return placed.withColumn(out, F.lead(quoted(carry)).over(ahead)).filter(F.col(ghost) == 0).select(*[quoted(c) for c in docs.columns], quoted(out))
