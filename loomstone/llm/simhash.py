"""SimHash near-dedup with pigeonring filtering.

Equal fingerprints collapse first. The 64 bits are a ring of four segments. Where two fingerprints differ in at most
three bits, some chain of consecutive segments has cumulative differences within the proportional budgets 0, 1, 2
and 3; so a pair is a candidate only where, from one start, a segment is equal, it and the next differ in at most one
bit, and so on round the ring. The first two budgets are an equality join: a 16-bit segment with the next one as it
is, met by the same with at most one bit flipped. The other two prune what the join yields before the full count.

Groups of very many near copies would meet in a few keys. Fingerprints in a crowded key are therefore first linked
through the fingerprints one bit away from them: all that share such a neighbour are at most two bits apart, so
the least of them can stand for the rest and no pair is formed. What remains are links of exactly three bits
between groups; the join is between fingerprints whose groups differ, and only groups that still meet another one in
a key take part. All joins are merges: whatever a session lets Spark broadcast, the driver holds no fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.arrays import lowered, slices, text_bytes, word_spans
from loomstone.llm.common import quoted
from loomstone.llm.components import components
from loomstone.session import cut

SEGMENTS, WIDTH, DISTANCE = 4, 16, 3
#: Keys that more fingerprints have than this are crowded.
CROWD = 64

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def over_half(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each text, whose hashes lie flat between its bounds: the bits that more than half of them have."""
    out, totals = np.zeros(len(bounds) - 1, np.uint64), np.diff(bounds)
    for bit in range(64):
        ones = np.concatenate(([0], np.cumsum((hashes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        over = 2 * (ones[bounds[1:]] - ones[bounds[:-1]]) > totals
        out |= over.astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit."""
    raw, starts = text_bytes(column)
    raw = lowered(raw)
    opens, closes, firsts = word_spans(raw, starts, _WORD)
    if not len(opens):
        return np.zeros(len(starts) - 1, np.uint64)
    # The words of all texts with one space after each; shingles are stretches of it.
    sizes = closes - opens
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    joined = np.full(at[-1], 0x20, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    mask = np.zeros(len(raw) + 1, np.int8)
    mask[opens] += 1
    mask[closes] -= 1
    joined[inside] = raw[np.cumsum(mask[:-1]).astype(bool)]
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    counts = firsts[1:] - firsts[:-1]
    n_shingles = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    texts = np.flatnonzero(counts)
    first = np.repeat(firsts[:-1][texts], n_shingles[texts])
    offset = np.arange(len(first)) - np.repeat(np.cumsum(n_shingles[texts]) - n_shingles[texts], n_shingles[texts])
    begin = first + offset
    end = begin + np.repeat(np.minimum(counts[texts], shingle), n_shingles[texts])
    hashes = np.fromiter(
        (digest(view[b:e], 42) for b, e in zip(at[begin].tolist(), (at[end] - 1).tolist(), strict=True)), np.uint64, len(begin)
    )
    return over_half(hashes, np.concatenate(([0], np.cumsum(n_shingles))))


def fingerprints(docs: DataFrame, text: str, doc_id: str, shingle: int = 3) -> DataFrame:
    """(id, fp) with the SimHash of each row's text as a signed long."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fps = _fingerprints(part.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(quoted(doc_id).alias("id"), quoted(text).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {rows.schema[0].dataType.simpleString()}, fp long")


def _segment(fp: Column, i: int) -> Column:
    """The i-th segment of the ring as an int."""
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def _differs(a: Column, b: Column, i: int) -> Column:
    return F.bit_count(_segment(a.bitwiseXOR(b), i))


def _key(fp: Column, i: int, flip: int = 0) -> Column:
    """Chain start i, its segment and the next with ``flip`` applied, as one long."""
    second = _segment(fp, i + 1).bitwiseXOR(F.lit(flip))
    return F.lit(i).cast("long") * F.lit(1 << 32) + _segment(fp, i) * F.lit(1 << 16) + second


def _near_by_neighbour(fps: DataFrame) -> DataFrame:
    """Links (src, dst) that join all fingerprints at most two bits apart: each to the least that shares a neighbour."""
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) if b < 63 else -(1 << 63))) for b in range(64)])
    around = fps.select("fp", F.explode(flips).alias("near"))
    least = around.groupBy("near").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter(F.col("least") != F.col("most"))
    return around.join(least.drop("most").hint("merge"), "near").filter(F.col("fp") != F.col("least")).select(F.col("fp").alias("src"), F.col("least").alias("dst")).distinct()


def links(fps: DataFrame) -> DataFrame:
    """Links (src, dst) between distinct fingerprints ``fp``, enough that their components are those of all pairs that
    differ in at most three bits; every link is such a pair."""
    probe = F.array(*[_key(F.col("fp"), i) for i in range(SEGMENTS)])
    flips = [0, *[1 << b for b in range(WIDTH)]]
    stored = F.array(*[_key(F.col("fp"), i, flip) for i in range(SEGMENTS) for flip in flips])

    crowded = (
        fps.select(F.explode(probe).alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("key")
    )
    crowd = cut(fps.select("fp", F.explode(probe).alias("key")).join(crowded.hint("merge"), "key", "left_semi").select("fp").distinct())
    near = cut(_near_by_neighbour(crowd))
    group = components(crowd.select(F.col("fp").alias("id")), near)
    grouped = fps.join(group.select(F.col("id").alias("fp"), "component").hint("merge"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("part")
    )
    # Each row becomes 68 keys, so that few small partitions would be few long tasks.
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = cut(grouped.repartition(spread))

    a = grouped.select(F.col("fp").alias("a"), F.col("part").alias("part_a"), F.explode(probe).alias("key"))
    b = grouped.select(F.col("fp").alias("b"), F.col("part").alias("part_b"), F.explode(stored).alias("key"))
    # A key in which all fingerprints are of one group has no link to add.
    both = (
        a.select("key", F.col("part_a").alias("part"), F.lit(1).alias("probes"))
        .unionByName(b.select("key", F.col("part_b").alias("part"), F.lit(0).alias("probes")))
        .groupBy("key")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("probes").alias("probes"))
        .filter((F.col("low") != F.col("high")) & (F.col("probes") == 1))
        .select("key")
    )
    start = F.shiftright(F.col("key"), 32)
    chain = None
    for i in range(SEGMENTS):
        x, y = F.col("a"), F.col("b")
        two = _differs(x, y, i) + _differs(x, y, i + 1)
        three = two + _differs(x, y, i + 2)
        budget = (start == i) & (two <= 1) & (three <= 2)
        chain = budget if chain is None else chain | budget
    pairs = (
        a.join(both.hint("merge"), "key", "left_semi")
        .join(b.hint("merge"), "key")
        .filter((F.col("part_a") != F.col("part_b")) & (F.col("a") < F.col("b")))
        .filter(chain & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .distinct()
    )
    return near.unionByName(pairs)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component): each row's SimHash as a signed long, and the least id reachable by links of at most
    three differing bits.

    A-Z are lower-cased; words are what space and tab to carriage return leave; shingles of ``shingle`` words,
    repeats included, are hashed by XXH64 with seed 42, and a bit of the fingerprint is set where more than half of the
    hashes have it. A text of fewer words has its whole sequence for shingle; one without words, null or empty, has
    fingerprint zero and is linked like any other. Rows with equal ids are rows of their own; a null id is never a
    component's name unless all ids in it are null. An empty table gives an empty table.
    """
    fp = cut(fingerprints(docs, text, doc_id, shingle))
    distinct = cut(fp.groupBy("fp").agg(F.min("id").alias("least")))
    joined = components(distinct.select(F.col("fp").alias("id")), links(distinct.select("fp")))
    least = cut(joined.select(F.col("id").alias("fp"), "component").join(distinct.hint("merge"), "fp"))
    names = cut(least.groupBy("component").agg(F.min("least").alias("name")))
    named = cut(least.join(names.hint("merge"), "component").select("fp", F.col("name").alias("component")))
    return fp.join(named.hint("merge"), "fp").select(F.col("id").alias(doc_id), "fp", "component")
