"""Token ids as files of bit-shuffled, compressed blocks with a chunk index.

Documents are dealt by ranges of their ids into shards, each a task that encodes its documents in order, cuts the
stream of ids into blocks of a fixed size, transposes each block into planes (plane k holds bit k of every id, or byte k),
and compresses each plane with zstandard. A block is a row of a Parquet file that the engine's own writer commits, so
that a lost executor leaves nothing half written and any store will do:

    shard, block      place of the block; blocks of a shard in order make up its ids
    n_ids             ids in the block
    planes            the compressed planes, lowest first
    doc_ids, doc_ends documents that end in the block, and the position in the block's ids after their last id

The chunk index is a second table: shard, block, the position of the block's first id among all ids, n_ids, and the length
of each compressed plane.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.arrays import slices
from loomstone.llm.common import quoted

#: Ids in a block; id 2 ends a document.
BLOCK_IDS, END_ID = 65_536, 2
#: Bytes of text that a shard is meant to hold, and that are encoded at a time.
SHARD_BYTES, PART_BYTES = 64 << 20, 1 << 20

BLOCK_SCHEMA = "shard int, block long, n_ids long, planes array<binary>, doc_ids array<long>, doc_ends array<long>"


def to_planes(ids: np.ndarray, by: str) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first; the highest ones that are empty are left out."""
    ids = np.ascontiguousarray(ids, "<u4")
    octets = ids.view(np.uint8).reshape(-1, 4)
    if by == "byte":
        planes = [octets[:, k].tobytes() for k in range(4)]
    else:
        planes = [np.packbits((ids >> np.uint32(k)) & np.uint32(1), bitorder="little").tobytes() for k in range(int(ids.max(initial=0)).bit_length())]
    while planes and not any(planes[-1]):
        planes.pop()
    return planes


def from_planes(planes: list[bytes], n: int, by: str) -> np.ndarray:
    """The ids whose planes these are."""
    if by == "byte":
        octets = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, np.uint8)
        return octets.view("<u4").reshape(-1)
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return ids


@lru_cache(maxsize=2)
def _library(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Encodes whole texts with the tokenizers library; one copy in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)]
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.concatenate(lists) if lists else np.zeros(0, np.uint32), sizes

    return encode


class _BlockWriter:
    """Gathers documents and gives out full blocks as rows."""

    def __init__(self, shard: int, by: str, level: int) -> None:
        self.shard, self.by, self.block = shard, by, 0
        self.pack = zstandard.ZstdCompressor(level=level)
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.docs: list[int | None] = []
        self.ends: list[int] = []

    def add(self, ids: np.ndarray, docs: list[int | None], sizes: np.ndarray) -> None:
        """Documents whose ids lie flat; ends count from the first id that is held."""
        self.docs += docs
        self.ends += (self.held + np.cumsum(sizes)).tolist()
        self.parts.append(ids)
        self.held += len(ids)

    def rows(self, all_of_it: bool) -> Iterator[dict]:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        at, done = 0, 0
        while len(ids) - at >= BLOCK_IDS or (all_of_it and at < len(ids)):
            block = ids[at : at + BLOCK_IDS]
            to = at + len(block)
            n = done
            while n < len(self.ends) and self.ends[n] <= to:
                n += 1
            yield {
                "shard": self.shard,
                "block": self.block,
                "n_ids": len(block),
                "planes": [self.pack.compress(p) for p in to_planes(block, self.by)],
                "doc_ids": self.docs[done:n],
                "doc_ends": [e - at for e in self.ends[done:n]],
            }
            at, done, self.block = to, n, self.block + 1
        self.parts, self.held = [ids[at:]], len(ids) - at
        self.docs, self.ends = self.docs[done:], [e - at for e in self.ends[done:]]


_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int64()),
        ("n_ids", pa.int64()),
        ("planes", pa.list_(pa.binary())),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int64())),
    ]
)


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int = END_ID,
    by: str = "byte",
    level: int = 3,
    shards: int | None = None,
) -> None:
    """Write the ids of every whole text, ``end_id`` after each, in ascending order of ``doc_id`` (a whole number).

    ``path`` gets ``blocks`` and ``index``. ``by``: planes of bits or bytes. ``shards``: how
    many, by default what gives about SHARD_BYTES of text each and keeps all partitions busy.

    Null and empty texts are the end id alone; null ids come first; rows that share an id lie side by side, by the hash of
    their texts, and are dealt over shards by it, too; rows that agree in both are alike. An empty table gives files without a
    row. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(doc_id).cast("long").alias("id"), quoted(text).cast("string").alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _library(tokenizer)
        writer = _BlockWriter(TaskContext.get().partitionId(), by, level)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                flat, sizes = encode(part.column("text"))
                ends = np.cumsum(sizes)
                writer.add(np.insert(flat, ends, end_id).astype(np.uint32), part.column("id").to_pylist(), sizes + 1)
                for row in writer.rows(False):
                    yield pa.RecordBatch.from_pylist([row], _ARROW)
        for row in writer.rows(True):
            yield pa.RecordBatch.from_pylist([row], _ARROW)

    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    dealt.mapInArrow(work, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    _index(spark.read.parquet(f"{path}/blocks")).write.parquet(f"{path}/index")


def _index(blocks: DataFrame) -> DataFrame:
    """The chunk index; the sums over shards, a row each, are the only thing that one task sees whole."""
    sizes = F.transform("planes", lambda p: F.octet_length(p).cast("long")).alias("plane_bytes")
    narrow = blocks.select("shard", "block", "n_ids", sizes)
    totals = narrow.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    return narrow.join(F.broadcast(before), "shard").select(
        "shard", "block", (F.col("base") + inside).alias("first_id"), "n_ids", "plane_bytes"
    )


def read_documents(
    spark: SparkSession, path: str, by: str = "byte", each: Callable[[np.ndarray], int] | None = None
) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files at ``path``: ids with the end id, and how many ids
    come before. With ``each``, a digest of the ids as long takes the place of the ids.

    A shard's blocks meet in one task in order; at most one block and one document are held at a time.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    index = spark.read.parquet(f"{path}/index").select("shard", "block", "first_id")
    rows = blocks.join(index.hint("shuffle_hash"), ["shard", "block"])
    shards = blocks.agg(F.max("shard")).first()[0]
    last = ("digest", pa.int64()) if each else ("ids", pa.list_(pa.int32()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        begun: list[np.ndarray] = []
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes([unpack.decompress(p) for p in row["planes"]], row["n_ids"], by)
                out, at = [], 0
                for doc, end in zip(row["doc_ids"], row["doc_ends"], strict=True):
                    own = np.concatenate([*begun, ids[at:end]]) if begun else ids[at:end]
                    begun = []
                    start = row["first_id"] + end - len(own)
                    out.append((doc, start, len(own), each(own) if each else own.astype(np.int32)))
                    at = end
                if at < len(ids):
                    begun.append(ids[at:])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    kind = "digest long" if each else "ids array<int>"
    dealt = rows.repartition(max(1, (shards or 0) + 1), "shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(work, f"doc_id long, start long, n_tokens long, {kind}")


def read_slice(spark: SparkSession, path: str, first: int, count: int, by: str = "byte") -> np.ndarray:
    """``count`` ids from position ``first`` on: the index finds the few blocks that hold them."""
    index = spark.read.parquet(f"{path}/index").filter((F.col("first_id") < first + count) & (F.col("first_id") + F.col("n_ids") > first))
    hit = spark.read.parquet(f"{path}/blocks").join(F.broadcast(index.select("shard", "block", "first_id")), ["shard", "block"])
    unpack = zstandard.ZstdDecompressor()
    out = np.zeros(count, np.uint32)
    for row in hit.select("first_id", "n_ids", "planes").toLocalIterator():
        ids = from_planes([unpack.decompress(bytes(p)) for p in row.planes], row.n_ids, by)
        a, b = max(first, row.first_id), min(first + count, row.first_id + row.n_ids)
        out[a - first : b - first] = ids[a - row.first_id : b - row.first_id]
    return out


def crc32(ids: np.ndarray) -> int:
    """The checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
