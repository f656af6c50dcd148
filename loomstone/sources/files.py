"""Readers and writers by format, archives, documents, and watched folders."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The formats that a path's ending names.
ENDINGS = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json", ".csv": "csv", ".txt": "text", ".xml": "xml"}


def read(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A table from files; the format from the path's ending unless it is named."""
    if format is None:
        format = next((f for ending, f in ENDINGS.items() if path.rstrip("/").endswith(ending)), "parquet")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def source(spark: SparkSession, path: str, format: str, schema: T.StructType | str, **options: str) -> DataFrame:
    """A stream of the files that come to be in a folder."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(value): a row per line; by default LF, CR and CRLF all end one."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row per file, read whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def decoded(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """(path, text): whole files in a charset."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", charset).alias("text"))


ENTRY = "archive string, name string, size long, modified timestamp, content binary"


def _entries(archive: str, content: bytes) -> Iterator[tuple]:
    """Name, size, time and content of each file of a tar (of any compression that tarfile knows) or zip archive."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield archive, i.filename, i.file_size, pd.Timestamp(*i.date_time), z.read(i)
        return
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        for member in t:
            if member.isfile():
                yield archive, member.name, member.size, pd.Timestamp(member.mtime, unit="s"), t.extractfile(member).read()


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, size, modified, content): a row per file in the tar and zip archives at a path.

    An archive is read by one task; entries leave it one at a time.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ENTRY.split(", ")]
        for frame in frames:
            for archive, content in zip(frame.path, frame.content, strict=True):
                for entry in _entries(archive, content):
                    yield pd.DataFrame([entry], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, ENTRY)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", by: tuple[str, ...] = (), **options: str) -> None:
    """Write a table, parted into folders ``by`` columns."""
    writer = df.write.mode(mode).format(format).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: tuple[str, ...], mode: str = "error") -> None:
    """Save a table in buckets of its keys, so that later joins and groupings on them need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def flow(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet", **options: str):
    """Start a query that writes a stream to files, and return it."""
    return stream.writeStream.format(format).options(**options).option("checkpointLocation", checkpoint).start(path)


def render(df: DataFrame, rows: int = 20, width: int = 20) -> str:
    """A table's first rows as text with ruled lines, columns as wide as what they show."""
    names = df.columns
    shown = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names]).limit(rows).collect()
    fit = lambda s: s if len(s) <= width else s[: width - 1] + "…"
    table = [[fit(n) for n in names]] + [[fit(v) for v in r] for r in shown]
    widths = [max(len(r[i]) for r in table) for i in range(len(names))]
    rule = lambda a, b, c: a + b.join("─" * (w + 2) for w in widths) + c
    line = lambda r: "│" + "│".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) + "│"
    return "\n".join([rule("┌", "┬", "┐"), line(table[0]), rule("├", "┼", "┤"), *map(line, table[1:]), rule("└", "┴", "┘")])
