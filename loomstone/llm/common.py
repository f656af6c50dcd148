"""Small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and the five control characters that count as white space: tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem = f"_{stem}"
        taken.add(stem.lower())
        names.append(stem)
    return names


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_body(df: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``df`` for a pass through Arrow, and the place of the column that has ``text`` as a string: the column itself, so that no
    batch holds a text twice, or where it is of another type a last column beside it."""
    places = [k for k, c in enumerate(df.columns) if c.lower() == text.lower()]
    if len(places) == 1 and df.schema[places[0]].dataType == T.StringType():
        return df, places[0]
    body, = fresh(df, "text_")
    return df.select(*[quoted(c) for c in df.columns], quoted(text).cast("string").alias(body)), len(df.columns)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; pure ASCII takes the fast built-in way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def wide_hash(value: Column) -> list[Column]:
    """Two independent 64-bit hashes: together wide enough for the lines of any corpus."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]
