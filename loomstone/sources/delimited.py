"""Delimited text: formats, typed rows, and all errors of a row in one column."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions.nested import flat_columns, nest_record


@dataclass(frozen=True)
class Format:
    """``delimiter``; whether the first line is a ``header``; ``quote``, which is doubled inside quoted cells."""

    delimiter: str = ","
    header: bool = False
    quote: str = '"'

    def options(self) -> dict[str, str]:
        return {
            "sep": self.delimiter,
            "header": str(self.header).lower(),
            "quote": self.quote,
            "escape": self.quote,
            "multiLine": "true",
            "mode": "PERMISSIVE",
        }


CSV, CSV_WITH_HEADER = Format(), Format(header=True)
TSV, TSV_WITH_HEADER = Format("\t"), Format("\t", header=True)
SSV, SSV_WITH_HEADER = Format(" "), Format(" ", header=True)


def _camel_words(name: str) -> list[str]:
    return re.sub(r"(?<!^)([A-Z])", r" \1", name).split(" ")


#: How a field's name is written as a heading.
RENAMES: dict[str, Callable[[str], str]] = {
    "unchanged": lambda name: name,
    "lower_words": lambda name: " ".join(_camel_words(name)).lower(),
    "lower_dotted": lambda name: ".".join(_camel_words(name)).lower(),
    "lower_slashed": lambda name: "/".join(_camel_words(name)).lower(),
    "capitalized_words": lambda name: " ".join(w[:1].upper() + w[1:] for w in _camel_words(name)),
}


def read_text_cells(spark: SparkSession, path: str, format: Format = CSV, columns: list[str] | None = None) -> DataFrame:
    """The file's rows with every cell as text; columns by heading, by ``columns``, or ``_c0`` and so on.

    Cells over several lines are whole. Of headings that repeat all columns stay; ``cell`` finds the last.
    """
    rows = spark.read.options(**format.options()).csv(path)
    return rows.toDF(*columns) if columns else rows


def cell(df: DataFrame, heading: str) -> Column:
    """The last column with a heading, as Spark tells repeated ones apart by a number at the end; null where there is none."""
    same = [c for c in df.columns if c == heading or re.fullmatch(re.escape(heading) + r"\d+", c)]
    exact = [c for c in same if c == heading]
    if exact:
        return F.col(f"`{heading}`")
    return F.col(f"`{same[-1]}`") if same else F.lit(None).cast("string")


def decode(df: DataFrame, schema: T.StructType, rename: str = "unchanged", errors: str = "errors", by_position: bool = False) -> DataFrame:
    """Typed columns from cells, with ``errors``: one text for each cell that is missing or does not parse.

    Nested records span as many cells as they have leaves, by position; else cells are found by heading. A cell that
    is absent is an error unless its field is nullable; booleans are ``true`` or ``false`` and nothing else.
    """
    leaves = flat_columns(schema)
    nullable = _leaf_nullability(schema)
    if by_position or any(isinstance(f.dataType, T.StructType) for f in schema.fields):
        cells = [F.col(f"`{c}`") for c in df.columns[: len(leaves)]]
        cells += [F.lit(None).cast("string")] * (len(leaves) - len(cells))
    else:
        cells = [cell(df, RENAMES[rename](name)) for name, _ in leaves]
    parsed, wrong = [], []
    for (name, kind), raw, may in zip(leaves, cells, nullable, strict=True):
        value = F.when(raw.isin("true", "false"), raw).try_cast(kind) if isinstance(kind, T.BooleanType) else raw.try_cast(kind)
        parsed.append(value)
        missing = F.lit(None) if may else F.when(raw.isNull(), F.lit(f"{name}: missing"))
        bad = F.when(raw.isNotNull() & value.isNull(), F.concat(F.lit(f"{name}: cannot read "), F.to_json(F.struct(raw.alias("cell")))))
        wrong.append(F.coalesce(missing, bad))
    found = F.filter(F.array(*wrong), lambda e: e.isNotNull())
    return df.select(*nest_record(schema, parsed), found.alias(errors))


def _leaf_nullability(schema: T.StructType) -> list[bool]:
    out: list[bool] = []
    for f in schema.fields:
        out += _leaf_nullability(f.dataType) if isinstance(f.dataType, T.StructType) else [f.nullable]
    return out


def misplaced_quotes(lines: DataFrame, column: str = "value", format: Format = CSV) -> DataFrame:
    """Lines of text with ``misplaced``: where a quote opens inside a cell that began without one, from 0; null if nowhere."""
    q, d = re.escape(format.quote), re.escape(format.delimiter)
    clean = f"^(?:(?:{q}(?:[^{q}]|{q}{q})*{q}[^{d}]*|[^{q}{d}]*){d})*[^{q}{d}]+(?={q})"
    hit = F.regexp_extract(F.col(column), clean, 0)
    return lines.withColumn("misplaced", F.when(hit != "", F.length(hit)))


def to_line(cells: Column, format: Format = CSV) -> Column:
    """An array of texts as one line: cells with the quote, the delimiter or a line break are quoted; null is empty."""
    q = format.quote
    special = "[" + re.escape(q) + re.escape(format.delimiter) + r"\r\n]"
    quoted = lambda c: F.concat(F.lit(q), F.replace(c, F.lit(q), F.lit(q + q)), F.lit(q))
    shown = lambda c: F.when(c.rlike(special), quoted(c)).otherwise(F.coalesce(c, F.lit("")))
    return F.array_join(F.transform(cells, shown), format.delimiter)


def write(df: DataFrame, path: str, format: Format = CSV_WITH_HEADER, mode: str = "error") -> None:
    """Write as delimited text, quoting only the cells that need it."""
    df.write.mode(mode).options(sep=format.delimiter, header=format.header, quote=format.quote, escape=format.quote, emptyValue="").csv(path)


def update(df: DataFrame, heading: str, f: Callable[[Column], Column], where: Column | None = None) -> DataFrame:
    """The rows with one cell changed in all of them, or in those that satisfy ``where``."""
    old = F.col(f"`{heading}`")
    return df.withColumn(heading, f(old) if where is None else F.when(where, f(old)).otherwise(old))
