"""Many literal terms searched at once, and keys looked up by their prefixes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.sequence import fresh

#: Code points of a text that are searched at a time; longer terms make larger pieces.
PIECE = 512
#: Terms, their code points in all and first letters that one regular expression holds.
MOST_TERMS, MOST_LETTERS, MOST_HEADS = 512, 8_192, 256
#: Code points of terms, and 16 for each, that every executor gets whole; more are shuffled.
MOST_BROADCAST = 1_000_000
_ANY = r"\x{0}-\x{d7ff}\x{e000}-\x{10ffff}"


def _literal(term: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in term)


def _places(heads: Iterable[str], then: str = "") -> str:
    """A regular expression of no width for the places, but the first, where a head and ``then`` follow."""
    heads = sorted(set(heads))
    return f"(?=[{_literal(''.join(heads)) if len(heads) <= MOST_HEADS else _ANY}]){then}(?!\\A)"


def _pieces(text: Column, size: int, longest: int) -> Column:
    """Array of struct(at, piece): ``size`` code points each, and so many of those that follow as a term there may reach over."""
    cut = f"(?s)(?=(.{{1,{size + longest - 1}}}+)).{{1,{size}}}+"
    return F.transform(F.regexp_extract_all(text, F.lit(cut), F.lit(1)), lambda p, j: F.struct((j * size).alias("at"), p.alias("piece")))


def _starts(piece: Column, places: str) -> Column:
    """Where the places of a piece are, from 0, and then its end. What goes before the piece is no place, so that each part ends at one."""
    parts = F.split(F.concat(F.lit("-"), piece), places, -1)
    step = lambda a, p: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(-1)) + F.length(p)))
    return F.reduce(parts, F.array().cast("array<int>"), step)


def term_hits(df: DataFrame, text: str, key: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(key, start, stop, term) of every occurrence of every term (a column of ``terms``), overlaps included.

    Texts are cut into pieces that overlap by the longest term. A piece yields its stretches as long as some term, and these
    meet the terms by equality, where few terms are broadcast; both the texts and the terms can be of any size. Start and stop count code points, stop
    exclusive. Null texts and empty and null terms have no occurrence; rows that share a key and a text count once.
    """
    known = terms.select(F.col(term).alias("term")).filter("length(term) > 0").distinct()
    # The lengths and first letters that terms have are few.
    shape = known.agg(F.sort_array(F.collect_set(F.length("term"))).alias("lengths"), F.collect_set(F.left("term", F.lit(1))).alias("heads"), F.coalesce(F.sum(F.length("term") + 16), F.lit(0)).alias("letters")).first()
    longest = (shape.lengths or [1])[-1]
    size, lengths = max(PIECE, longest), F.array(*map(F.lit, shape.lengths or [1]))
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("length(text) > 0")
    pieces = rows.select("key", F.explode(_pieces(F.col("text"), size, longest)).alias("p")).select("key", "p.at", "p.piece")
    places = F.filter(_starts(F.col("piece"), _places(shape.heads or [""])), lambda i: i < F.least(F.length("piece"), F.lit(size)))
    tails = pieces.select("key", "at", "piece", F.explode(places).alias("i")).select("key", (F.col("at") + F.col("i")).alias("start"), F.substr("piece", F.col("i") + 1, F.lit(longest)).alias("tail"))
    ways = F.transform(F.filter(lengths, lambda n: n <= F.length("tail")), lambda n: F.struct(n.alias("n"), F.left("tail", n).alias("term")))
    each = tails.select("key", "start", F.explode(ways).alias("w")).select("key", "start", "w.*")
    sought = F.broadcast(known) if shape.letters <= MOST_BROADCAST else known
    return each.join(sought, "term", "left_semi").select("key", "start", (F.col("start") + F.col("n")).alias("stop"), "term").distinct()


def _found(text: Column, terms: list[str]) -> Column:
    """Array of struct(start, stop, term) in a text, by start and stop, for few terms.

    One regular expression finds the places of a piece and the longest term at each; the others there are its beginnings.
    """
    by_length = sorted(terms, key=len)
    longest = len(by_length[-1])
    size = max(PIECE, longest)
    places = _places((t[0] for t in terms), f"(?=({'|'.join(map(_literal, reversed(by_length)))}))")
    begins = F.create_map(*[c for t in terms for c in (F.lit(t), F.array(*[F.lit(w) for w in by_length if t.startswith(w)]))])

    def hits(piece: Column, at: Column) -> Column:
        tops = F.regexp_extract_all(F.concat(F.lit("-"), piece), F.lit(places), F.lit(1))
        hit = lambda s, w: F.struct((at + s).alias("start"), (at + s + F.length(w)).alias("stop"), w.alias("term"))
        each = F.zip_with(_starts(piece, places), tops, lambda s, t: F.when(t.isNotNull() & (s < size), F.transform(begins[t], lambda w: hit(s, w))))
        return F.flatten(F.filter(each, lambda h: h.isNotNull()))

    return F.flatten(F.transform(_pieces(text, size, longest), lambda p: hits(p["piece"], p["at"])))


def multi_search(df: DataFrame, text: str, key: str, terms: list[str], out: str = "found") -> DataFrame:
    """``df`` with ``out``: array of struct(start, stop, term) of every occurrence of every term, overlaps included, by start
    and stop. A text without any, null or not, has an empty array.

    Up to ``MOST_TERMS`` terms are searched within each row; more are joined by ``term_hits``, which tells rows apart by ``key``.
    """
    spark, name = df.sparkSession, fresh(df, "key_")[0]
    none = F.array().cast("array<struct<start:int,stop:int,term:string>>")
    kept, sought = df.drop(out), sorted({t for t in terms if t})
    if not sought:
        return kept.withColumn(out, none)
    if len(sought) <= MOST_TERMS and sum(map(len, sought)) <= MOST_LETTERS:
        return kept.withColumn(out, F.coalesce(_found(df[text].cast("string"), sought), none))
    hits = term_hits(df, text, key, spark.createDataFrame([(t,) for t in sought], "term string"))
    found = hits.groupBy(F.col("key").alias(name)).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "term"))).alias(out))
    joined = kept.join(found, F.col(key).eqNullSafe(F.col(name)), "left")
    return joined.select(*kept.columns, F.coalesce(out, none).alias(out))


def longest_prefix(df: DataFrame, key: str, table: DataFrame, prefix: str, value: str) -> DataFrame:
    """``df`` with ``value`` of the longest ``prefix`` in the table that its key begins with, or null.

    The distinct keys are joined by their own prefixes of those lengths that the table has. A null key has none; a column
    of that name gives way.
    """
    k, = fresh(df, "key_")
    keys = df.select(F.col(key).alias("k")).distinct()
    known = table.select(F.col(prefix).alias("p"), F.col(value).alias("v"))
    lengths = known.agg(F.sort_array(F.collect_set(F.length("p"))).alias("l")).first().l
    ways = F.transform(F.filter(F.array(*map(F.lit, lengths or [0])), lambda n: n <= F.length("k")), lambda n: F.left("k", n))
    hits = keys.select("k", F.explode(ways).alias("p")).join(known, "p")
    best = hits.groupBy("k").agg(F.max_by("v", F.length("p")).alias(value)).withColumnRenamed("k", k)
    return df.drop(value).join(best, F.col(key) == F.col(k), "left").drop(k)


def trie_lookup(df: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """``df`` with the columns of the row of ``table`` that has exactly its key, or null: an equality join."""
    return df.join(table, F.col(key) == F.col(table_key), "left")
