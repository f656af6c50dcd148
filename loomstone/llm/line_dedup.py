"""Line dedup: drop the lines that many documents share.

Lines are exploded as 128-bit hashes of their normalised form, documents are counted per hash with partial sums
before the shuffle, the positions of frequent lines are gathered per document, and the kept lines are put
together by position. Texts move once, and only to meet the positions to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import SPACES, ascii_lower, fresh, quoted, wide_hash
from loomstone.session import cut

#: Frequent keys go to every executor while there are at most so many (32 bytes each); beyond, they are shuffled.
BROADCAST_KEYS = 500_000
#: Beyond that, keys that at least so many documents have are joined apart from the rest, to keep one key off one task.
HOT_DOCS = 100_000


def line_key(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.trim(line, F.lit(SPACES))


def _keys(text: Column) -> Column:
    return F.transform(F.split(ascii_lower(text), "\n", -1), line_key)


def frequent_keys(texts: DataFrame, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(h1, h2, n_docs) of each line key with at least ``min_chars`` code points that rows of at least ``min_docs`` ids have.

    Keys and ids meet first, so that a very common key is dealt by its documents; then documents are counted.
    """
    h1, h2 = wide_hash(F.col("key"))
    return (
        texts.select("id", F.explode(F.array_distinct(_keys(F.col(text)))).alias("key"))
        .filter(F.length("key") >= min_chars)
        .groupBy(h1.alias("h1"), h2.alias("h2"), "id")
        .agg(F.lit(0).alias("x"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"))
        .filter(F.col("n_docs") >= min_docs)
    )


def _only_frequent(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose key is frequent; a key that fills a task by itself never goes through a shuffle."""
    keys = frequent.select("h1", "h2")
    if frequent.count() <= BROADCAST_KEYS:
        return lines.join(F.broadcast(keys), ["h1", "h2"], "left_semi")
    hot = frequent.filter(F.col("n_docs") >= HOT_DOCS).select("h1", "h2")
    if hot.count() > BROADCAST_KEYS:
        # The keys are a written table, so that both sides are plain exchanges and AQE splits the hot ones.
        return lines.join(keys, ["h1", "h2"], "left_semi")
    return lines.join(F.broadcast(hot), ["h1", "h2"], "left_semi").unionByName(
        lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(keys, ["h1", "h2"], "left_semi")
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` rid of frequent lines, and ``n_lines`` and ``n_dropped`` (long) beside it.

    A text is split at line feeds. A line's key is the line without white space (space, tab to carriage return) at
    its ends and with A-Z in lower case. Keys of at least ``min_chars`` code points that at least ``min_docs`` documents
    have lose all their lines in every row; what stays is joined by line feeds.

    Nulls: a null text is one empty line and comes out empty; a null id is an id like any other. Rows that share an id are
    one document, in which a key counts once, and each has its own text. An empty text has one line. An empty table gives an empty
    table. Columns of ``docs`` named ``n_lines`` or ``n_dropped`` give way to the new ones; all others are kept.
    """
    lines_, bad_, t1, t2, id_ = fresh(docs, "lines_", "bad_", "t1_", "t2_", "id_")
    rows = docs.withColumn(text, F.coalesce(quoted(text).cast("string"), F.lit("")))
    narrow = rows.select(quoted(doc_id).alias("id"), quoted(text).alias("text"))
    frequent = cut(frequent_keys(narrow, "text", min_docs, min_chars))

    w1, w2 = wide_hash(F.col("text"))
    h1, h2 = wide_hash(F.col("key"))
    exploded = narrow.select("id", w1.alias(t1), w2.alias(t2), F.posexplode(_keys(F.col("text"))).alias("pos", "key")).filter(
        F.length("key") >= min_chars
    )
    found = _only_frequent(exploded.select("id", t1, t2, "pos", h1.alias("h1"), h2.alias("h2")), frequent)
    bad = found.groupBy(F.col("id").alias(id_), t1, t2).agg(F.collect_set("pos").alias(bad_))

    w1, w2 = wide_hash(quoted(text))
    whole = rows.withColumns({t1: w1, t2: w2, lines_: F.split(quoted(text), "\n", -1)}).drop(text)
    joined = whole.join(
        bad.hint("shuffle_hash"),
        quoted(doc_id).eqNullSafe(F.col(id_)) & (whole[t1] == bad[t1]) & (whole[t2] == bad[t2]),
        "left",
    )
    n = F.size(lines_)
    kept = F.when(F.col(bad_).isNull(), F.col(lines_)).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col(bad_)), lambda i: F.get(F.col(lines_), i))
    )
    out = [F.array_join(kept, "\n").alias(text) if c == text else quoted(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*out, n.cast("long").alias("n_lines"), F.coalesce(F.size(bad_), F.lit(0)).cast("long").alias("n_dropped"))
