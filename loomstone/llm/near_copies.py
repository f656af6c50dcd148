"""Near copies: SimHash with pigeonring finds the closest, MinHash bands and rare shingles what lies beyond its bits, and the
exact Jaccard similarity decides on every pair.

Words are what space and tab to carriage return leave, A-Z in lower case; shingles are five words, and a shorter text
has its whole sequence for shingle. Two texts are near copies where their sets of shingles have a Jaccard similarity of
0.8 or more. Texts with the same shingles, repeats included, collapse first.

Three searches give candidates. First, SimHash fingerprints of the shingles, linked at three or fewer differing bits as in
``simhash``: a text is compared with one of its own fingerprint, and a fingerprint's with one of the least fingerprint that it
is linked to. At a similarity of 0.8 about ten of 64 bits differ, and a budget of sixteen, which most such pairs keep, leaves no
segment of a useful width equal. So, second, MinHash bands: a band is ROWS minima together, so that two such texts share one
of BANDS bands with a probability of at least 1 - (1 - 0.8**5)**24, over 0.9999. In a band every text is compared with the
band's centre, the text that shares most bands with others; groups of very many near copies become one component by
that. Third, texts that still share a band with another component are joined by shingle: ordered by rarity among them, two
texts with n and m shingles of which at least o = 4 (n + m) / 9 are shared have one in common among the first n - o + 1 and
m - o + 1. Where a shingle is in one large component and a few other texts, only these meet the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.arrays import SpanHasher, combine, lowered, mix, ranges, slices, text_bytes, word_spans
from loomstone.llm.common import fresh, quoted, wide_hash
from loomstone.llm.components import components
from loomstone.llm.simhash import links, over_half
from loomstone.session import cut

SHINGLE, BANDS, ROWS = 5, 24, 5
#: The least similarity, SHARE of OF.
SHARE, OF = 4, 5
#: Texts to compare are picked by a broadcast of ids while there are at most so many; beyond, by a shuffle.
BROADCAST_IDS = 500_000

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Odd factors: each orders the hashes, which are well mixed before, in another way.
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of all texts, flat, and where each text's begin (one more than texts)."""
    raw, starts = text_bytes(column)
    raw = lowered(raw)
    opens, closes, first = word_spans(raw, starts, _WORD)
    words = SpanHasher(raw)(opens, closes)
    n = np.diff(first)
    counts = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(bounds[-1], np.uint64)
    for width in range(1, SHINGLE + 1):
        texts = np.flatnonzero(n == width if width < SHINGLE else n >= SHINGLE)
        if len(texts):
            out[ranges(bounds[texts], counts[texts])] = mix(combine(words, width)[ranges(first[texts], counts[texts])] + np.uint64(width))
    return out, bounds


def _keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A key of each text's shingles, repeats included, in any order; zero without words."""
    keys, texts = np.zeros(len(bounds) - 1, np.uint64), np.flatnonzero(np.diff(bounds))
    if len(texts):
        keys[texts] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds[texts]))
    return keys


def _signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key, the fingerprint and the BANDS band values of each text; a text without words has zeros."""
    hashes, bounds = _shingles(column)
    keys, bands = _keys(hashes, bounds), np.zeros((len(column), BANDS), np.uint64)
    texts = np.flatnonzero(np.diff(bounds))
    if len(texts):
        at = bounds[texts]
        for band in range(BANDS):
            value = np.full(len(texts), band + 1, np.uint64)
            for factor in _FACTORS[band * ROWS : (band + 1) * ROWS]:
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashes * factor, at))
            bands[texts, band] = value
    return keys, over_half(hashes, bounds), bands


def _signed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, h1, h2, key, fp, bands) of each row, with the hash of its text, null as empty."""
    h1, h2 = wide_hash(F.coalesce(quoted(text).cast("string"), F.lit("")))
    rows = docs.select(quoted(doc_id).alias("id"), h1.alias("h1"), h2.alias("h2"), quoted(text).cast("string").alias("text"))

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, fps, bands = _signatures(part.column("text"))
                flat = pa.array(bands.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
                kept = [part.column(c) for c in ("id", "h1", "h2")]
                made = [pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=["id", "h1", "h2", "key", "fp", "bands"])

    return rows.mapInArrow(work, f"id {rows.schema[0].dataType.simpleString()}, h1 long, h2 long, key long, fp long, bands array<long>")


def _sets(column: pa.Array) -> list[np.ndarray]:
    hashes, bounds = _shingles(column)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(len(a) + len(b) - shared, 1)


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose texts are near copies."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "a"):
                ours, theirs = _sets(part.column("a")), _sets(part.column("b"))
                good = [similarity(x, y) >= SHARE / OF for x, y in zip(ours, theirs, strict=True)]
                yield part.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    # Both sides of each join are plain exchanges, so that AQE can split a text that many are compared with.
    near = pairs.join(texts.select(F.col("key").alias("src"), F.col("text").alias("a")), "src")
    near = near.join(texts.select(F.col("key").alias("dst"), F.col("text").alias("b")), "dst")
    return near.select("src", "dst", "a", "b").mapInArrow(work, "src long, dst long")


def _simhash_pairs(each: DataFrame) -> DataFrame:
    """Candidates (src, dst) among the rows (key, fp) of ``each`` by pigeonring: every key with the least of its fingerprint,
    and that one with the least key of the least fingerprint to which a link leads."""
    head = cut(each.groupBy("fp").agg(F.min("key").alias("head")))
    same = each.join(head.hint("merge"), "fp").filter("key != head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    # Links in a crowd are up to 65 a fingerprint; one of each keeps the texts to compare as many as the fingerprints.
    near = links(head.select("fp")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    near = near.groupBy("src").agg(F.min("dst").alias("dst"))
    near = near.join(head.select(F.col("fp").alias("src"), F.col("head").alias("a")).hint("merge"), "src")
    near = near.join(head.select(F.col("fp").alias("dst"), F.col("head").alias("b")).hint("merge"), "dst")
    return same.unionByName(near.select("a", "b")).select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))


def _band_pairs(members: DataFrame) -> DataFrame:
    """Candidates (src, dst) of rows (key, band, n): each key with the centre of its band."""
    star = members.select("key", "band").join(cut(_centres(members)), "band").filter("key != centre")
    return star.select(F.greatest("key", "centre").alias("src"), F.least("key", "centre").alias("dst"))


def _centres(members: DataFrame) -> DataFrame:
    """(band, centre) of rows (key, band, n): of the keys in a band the one with the largest bands."""
    weight = members.groupBy("key").agg(F.sum("n").alias("weight"))
    weighed = members.select("key", "band").join(weight, "key")
    return weighed.groupBy("band").agg(F.max(F.struct("weight", "key")).alias("c")).select("band", F.col("c.key").alias("centre"))


def _rare_pairs(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (src, dst) among the rows (key, n, part) of ``left`` in different parts, by rare shingles."""
    tokens = cut(_tokens(texts.join(left.select("key"), "key", "left_semi")))
    counts = cut(tokens.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"))
    mine = Window.partitionBy("key")
    rank = F.row_number().over(mine.orderBy("df", "shingle")) - 1
    known = tokens.join(counts, "shingle").select("key", "shingle", rank.alias("rank"), F.count("*").over(mine).alias("common"))
    # Shingles that no other text has come first.
    at = F.col("n") - F.col("common") + F.col("rank")
    placed = known.join(left, "key").select("shingle", "key", "part", "n", at.alias("at"))
    prefix = cut(placed.filter(F.col("n") - F.col("at") >= F.ceil(F.col("n") * SHARE / OF)))

    sizes = prefix.groupBy("shingle", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("n", "part")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    main = cut(main.select("shingle", F.col("m.part").alias("main")))
    mixed = prefix.join(main, "shingle")
    few = mixed.filter("part != main").select("shingle", F.col("key").alias("a"), F.col("part").alias("p"), F.col("n").alias("k"), F.col("at").alias("i"))
    rest = mixed.select("shingle", F.col("key").alias("b"), F.col("part").alias("q"), F.col("n").alias("m"), F.col("at").alias("j"))
    # The shared shingles o that the similarity asks for: o * (SHARE + OF) >= SHARE * (k + m).
    need = SHARE * (F.col("k") + F.col("m"))
    enough = ((F.col("k") - F.col("i")) * (SHARE + OF) >= need) & ((F.col("m") - F.col("j")) * (SHARE + OF) >= need)
    sized = F.least("k", "m") * OF >= F.greatest("k", "m") * SHARE
    pairs = few.join(rest, "shingle").filter((F.col("p") != F.col("q")) & sized & enough)
    return pairs.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()


def _parts(docs: DataFrame, each: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(key, component) of the keys that share a band or a near fingerprint with another: the least key that near copies reach.

    ``each``: (key, least, fp, bands), a row for each key with the least id that has it.
    """
    close = cut(_simhash_pairs(each))
    every = each.select("key", F.explode("bands").alias("band"))
    shared = cut(every.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    members = cut(every.join(shared, "band"))
    asked = members.select("key").unionByName(close.select(F.col("src").alias("key"))).unionByName(close.select(F.col("dst").alias("key")))
    asked = cut(asked.distinct())
    # One row's text for each key: of the rows that have it, one of those with the least id.
    ids = each.join(asked, "key", "left_semi").select(F.col("least").alias("rep")).distinct()
    few = F.broadcast if ids.count() <= BROADCAST_IDS else (lambda df: df.hint("shuffle_hash"))
    picked = docs.select(quoted(doc_id).alias("id"), quoted(text).cast("string").alias("text")).join(
        few(ids), F.col("id").eqNullSafe(F.col("rep")), "left_semi"
    )
    texts = cut(_keyed(picked).dropDuplicates(["key"]).join(asked, "key", "left_semi"))

    stars = cut(close.unionByName(_band_pairs(members)).distinct())
    part = components(texts.select(F.col("key").alias("id")), _similar(stars, texts)).select(F.col("id").alias("key"), F.col("component").alias("part"))
    sized = cut(texts.select("key", "n").join(part, "key"))

    # Bands that hold more than one component, and what is in them.
    tagged = members.select("key", "band").join(sized.select("key", "part"), "key")
    mixed = cut(tagged.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high").select("band"))
    left = sized.join(members.join(mixed, "band", "left_semi").select("key").distinct(), "key", "left_semi")
    pairs = _rare_pairs(left, texts).join(stars, ["src", "dst"], "left_anti")
    more = _similar(cut(pairs), texts)
    # The components of these links between components.
    tops = sized.select("key", "part")
    more = more.join(tops.withColumnRenamed("key", "src"), "src").select("dst", F.col("part").alias("p"))
    more = cut(more.join(tops.withColumnRenamed("key", "dst"), "dst").select(F.col("p").alias("src"), F.col("part").alias("dst")))
    if more.isEmpty():
        return tops.withColumnRenamed("part", "component")
    joined = components(tops.select(F.col("part").alias("id")).distinct(), more)
    return tops.join(joined.withColumnRenamed("id", "part"), "part").select("key", "component")


def _tokens(texts: DataFrame) -> DataFrame:
    """(key, shingle): each shingle of each row (key, text) once."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part.column("text"))
                owner = np.repeat(np.arange(part.num_rows), [len(s) for s in sets])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(owner)), pa.array(flat)], names=["key", "shingle"])

    return texts.select("key", "text").mapInArrow(work, "key long, shingle long")


def _keyed(rows: DataFrame) -> DataFrame:
    """(key, n, text) of rows (id, text): ``n`` distinct shingles."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = _shingles(part.column("text"))
                keys = _keys(hashes, bounds)
                n = pa.array([len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), n, part.column("text")], names=["key", "n", "text"])

    return rows.select("text").mapInArrow(work, "key long, n long, text string")


def _grouped(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, h1, h2, component) of each row: its id, the hash of its text, and the least key that near copies reach."""
    signed = cut(_signed(docs, text, doc_id))
    each = cut(signed.groupBy("key").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    parts = cut(_parts(docs, each, text, doc_id))
    component = F.coalesce("component", "key").alias("component")
    return signed.select("id", "h1", "h2", "key").join(parts, "key", "left").select("id", "h1", "h2", component)


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, component): the least id reachable by steps between near copies.

    Texts without words, null or empty, are copies of each other. Rows with equal ids are rows of their own; a null id
    is a component's name only where all its ids are null. An empty table gives an empty table.
    """
    rows = cut(_grouped(docs, text, doc_id))
    names = cut(rows.groupBy("component").agg(F.min("id").alias("name")))
    return rows.join(names, "component").select(F.col("id").alias(doc_id), F.col("name").alias("component"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` of each group of near copies: the one with the least id, null after all others, and of rows with
    that id the one whose text has the least hash; of rows that agree in both, any one. Other columns do not matter and
    are kept. Null and empty texts are one group. An empty table stays empty.
    """
    names = fresh(docs, "id_", "h1_", "h2_")
    rows = cut(_grouped(docs, text, doc_id))
    # Of each group the first (id, text), with how many rows have both.
    same = rows.groupBy("component", "id", "h1", "h2").agg(F.count("*").alias("n"))
    first = same.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2", "n")).alias("f"))
    kept = cut(first.select(*[F.col(f"f.{c}").alias(n) for c, n in zip(("id", "h1", "h2"), names, strict=True)], "f.n"))
    many = kept.filter("n > 1")
    kept = kept.drop("n")

    h1, h2 = wide_hash(F.coalesce(quoted(text).cast("string"), F.lit("")))
    marked = docs.withColumns({f"{names[0]}x": quoted(doc_id), f"{names[1]}x": h1, f"{names[2]}x": h2})
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"{n}x").eqNullSafe(F.col(n))
    columns = [quoted(c) for c in docs.columns]
    out = marked.join(kept.hint("shuffle_hash"), same, "left_semi")
    if many.isEmpty():
        return out.select(*columns)
    again = out.join(many.hint("shuffle_hash"), same, "left_semi").dropDuplicates([f"{n}x" for n in names])
    return out.join(many.hint("shuffle_hash"), same, "left_anti").select(*columns).unionByName(again.select(*columns))
