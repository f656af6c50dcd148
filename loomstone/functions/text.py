"""Text functions. Lengths and positions count code points from 0. White space is Unicode's unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

_SPACE = r"[\s\u0085\p{Z}]"


def quote(literal: str) -> str:
    """A pattern for Java that matches the literal."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def cut(s: Column, delimiter: str, limit: int = -1) -> Column:
    """Split at a literal; trailing empty pieces stay."""
    return F.split(s, quote(delimiter), limit)


def words(s: Column) -> Column:
    return F.split(s, " ", -1)


def lines(s: Column) -> Column:
    return F.split(s, "\n", -1)


def delineate(s: Column) -> Column:
    """Lines under any of CRLF, LF and CR."""
    return F.split(s, "\\r\\n|\\n|\\r", -1)


def unkebab(s: Column) -> Column:
    return F.split(s, "-", -1)


def unsnake(s: Column) -> Column:
    return F.split(s, "_", -1)


def uncamel(s: Column) -> Column:
    """camelCase as lower-case words."""
    return F.split(F.lower(F.regexp_replace(s, "(?<!^)([A-Z])", " $1")), " ", -1)


def capitalize(s: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def uncapitalize(s: Column) -> Column:
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def pascal(ws: Column) -> Column:
    return F.array_join(F.transform(ws, lambda w: capitalize(F.lower(w))), "")


def camel(ws: Column) -> Column:
    return uncapitalize(pascal(ws))


def snake(ws: Column) -> Column:
    return F.array_join(ws, "_")


def kebab(ws: Column) -> Column:
    return F.array_join(ws, "-")


def spaced(ws: Column) -> Column:
    return F.array_join(ws, " ")


def join_and(a: Column, separator: str = ", ", last: str = " and ") -> Column:
    """The pieces joined, with another separator before the last."""
    head = F.array_join(F.slice(a, F.lit(1), F.size(a) - 1), separator)
    return F.when(F.size(a) < 2, F.array_join(a, "")).otherwise(F.concat(head, F.lit(last), F.element_at(a, -1)))


def slices(s: Column, n: int) -> Column:
    """Substrings of ``n`` characters; the last may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(n))
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(s, i, F.lit(n))))


def chars(s: Column) -> Column:
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def punch(s: Column, n: int) -> Column:
    """struct(left, right) around character ``n``, which goes."""
    return F.struct(F.left(s, F.lit(n)).alias("left"), F.substring(s, F.lit(n + 2), F.length(s)).alias("right"))


def offset_of(s: Column, part: str, right: bool = False) -> Column:
    """The first or the last position of a literal, or null."""
    if right:
        at = F.instr(F.reverse(s), part[::-1])
        return F.when(at > 0, F.length(s) - at - len(part) + 1)
    return F.nullif(F.instr(s, part), F.lit(0)) - 1


def count(s: Column, part: str) -> Column:
    """Occurrences of a literal that do not overlap; 0 for an empty one."""
    return F.regexp_count(s, F.lit(quote(part))) if part else F.lit(0)


def count_chars(s: Column, p: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(chars(s), p))


def chomp(s: Column, part: str, right: bool = True) -> Column:
    """The text without one suffix, or prefix, where it has it."""
    n = len(part)
    if right:
        return F.when(s.endswith(part), F.left(s, F.length(s) - n)).otherwise(s)
    return F.when(s.startswith(part), F.substring(s, F.lit(n + 1), F.length(s))).otherwise(s)


def trim(s: Column, left: bool = True, right: bool = True) -> Column:
    """The text without white space at its ends."""
    pattern = "|".join([f"^{_SPACE}+"] * left + [f"{_SPACE}+$"] * right)
    return F.regexp_replace(s, pattern, "") if pattern else s


def blank(s: Column) -> Column:
    return s.rlike(f"^{_SPACE}*$")


def pad(s: Column, n: int, fill: str = " ", right: bool = False) -> Column:
    """Filled up to ``n`` characters on the right, or the left; never shortened."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, fill) if right else F.rpad(s, n, fill))


def center(s: Column, n: int, fill: str = " ") -> Column:
    left = F.greatest(F.length(s), F.length(s) + F.floor((n - F.length(s)) / 2)).cast("int")
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(F.lpad(s, left, F.lit(fill)), F.lit(n), F.lit(fill)))


def fit(s: Column, n: int, fill: str = " ", right: bool = False) -> Column:
    """Filled up or shortened to exactly ``n`` characters."""
    return F.right(pad(s, n, fill, True), F.lit(n)) if right else F.rpad(s, n, fill)


def erase(s: Column, letters: str) -> Column:
    return F.translate(s, letters, "")


def tr(s: Column, source: str, target: str) -> Column:
    return F.translate(s, source, target)


def ossify(s: Column) -> Column:
    """Spaces as no-break spaces."""
    return F.translate(s, " ", " ")


# Unicode's sub- and superscripts of these characters.
_PLAIN = "0123456789+-=()"
_SUB = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"
_SUPER = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾"


def subscripts(s: Column) -> Column:
    """Digits and signs as subscripts; others as spaces."""
    return F.translate(F.regexp_replace(s, r"[^0-9+\-=()]", " "), _PLAIN, _SUB)


def superscripts(s: Column) -> Column:
    return F.translate(F.regexp_replace(s, r"[^0-9+\-=()]", " "), _PLAIN, _SUPER)


def sub(s: Column, part: str, replacement: str, n: int | None = None) -> Column:
    """All or the first ``n`` occurrences of a literal replaced; the replacement is literal too."""
    if n is None:
        return F.replace(s, F.lit(part), F.lit(replacement))
    pieces = F.split(s, quote(part), n + 1)
    return F.array_join(pieces, replacement)


def sub_pattern(s: Column, pattern: str, replacement: str, n: int | None = None) -> Column:
    """All or the first ``n`` matches replaced."""
    if n is None:
        return F.regexp_replace(s, pattern, replacement)
    compiled, template = re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", replacement)

    @pandas_udf(T.StringType())
    def first(x: pd.Series) -> pd.Series:
        return x.map(lambda t: compiled.sub(template, t, count=n), na_action="ignore")

    return first(s)


def broken(s: Column, left: str, right: str, mark: str = "​") -> Column:
    """``mark`` between neighbours of which the first is of class ``left`` and the second of class ``right``."""
    return F.regexp_replace(s, f"(?<={left})(?={right})", mark)


def fill(n: Column | int, letter: Callable[[Column], Column]) -> Column:
    """``n`` characters, each by its position."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), letter), ""))


def pluralize(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


# Patterns


def glob(pattern: str) -> str:
    """A pattern for Java that matches whole paths: ``*`` within a part, ``**`` across, ``?``, ``[a-z]``, ``[!a-z]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", close + 1
            continue
        out += "[^/\\\\]*" if c == "*" else "[^/\\\\]" if c == "?" else re.sub(r"([^\w\s])", r"\\\1", c)
        i += 1
    return f"^{out}$"


def matches(s: Column, pattern: str) -> Column:
    """Whether the whole text matches."""
    return s.rlike(f"^(?:{pattern})$")


def search(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def search_spans(s: Column, pattern: str) -> Column:
    """struct(start, stop) of each match, from the lengths of pieces and matches."""
    own = F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.length)
    between = F.transform(F.split(s, pattern, -1), F.length)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(own)), own, lambda b, o: F.struct(b.alias("gap"), o.alias("own")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        stop = start + x["own"]
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("out"))

    return F.aggregate(steps, zero, step, lambda state: state["out"])


def seek_span(s: Column, pattern: str) -> Column:
    """struct(start, stop) of the first match, or null."""
    at = F.regexp_instr(s, F.lit(pattern))
    stop = at - 1 + F.length(F.regexp_extract(s, pattern, 0))
    return F.when(at > 0, F.struct((at - 1).alias("start"), stop.alias("stop")))


# Likeness


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity; two empty texts are alike."""
    return _jaro(a, b)


def _jaro_of(x: str | None, y: str | None) -> float | None:
    if x is None or y is None:
        return None
    if x == y:
        return 1.0
    reach = max(max(len(x), len(y)) // 2 - 1, 0)
    taken, hits = [False] * len(y), []
    for i, c in enumerate(x):
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            if not taken[j] and y[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(y, taken, strict=True) if t]
    m = len(hits)
    swaps = sum(p != q for p, q in zip(hits, other, strict=True)) / 2
    return (m / len(x) + m / len(y) + (m - swaps) / m) / 3


@pandas_udf(T.DoubleType())
def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_jaro_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def common_prefix(a: Column, b: Column, most: int = 4) -> Column:
    """The length of the common prefix, up to ``most``."""
    same = [F.lit(k) for k in range(1, most + 1)]
    return F.size(F.filter(F.array(*same), lambda k: (F.least(F.length(a), F.length(b)) >= k) & (F.left(a, k) == F.left(b, k))))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro similarity raised by a tenth of the rest for each of up to four characters of a common prefix."""
    j = jaro(a, b)
    return j + common_prefix(a, b) * 0.1 * (1 - j)


def levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """The edit distance; null beyond ``most``, if given."""
    if most is None:
        return F.levenshtein(a, b)
    found = F.levenshtein(a, b, most)
    return F.when(found >= 0, found)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / n)


def closest(s: Column, cases: list[str]) -> Column:
    """The literal with the least edit distance, the first among equals."""
    ranked = F.array(*[F.struct(F.levenshtein(s, F.lit(c)).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(cases)])
    return F.array_min(ranked)["c"]


def smart_case_equal(a: Column, b: Column) -> Column:
    """Whether the texts agree, where a lower-case letter on the left matches either case."""
    pairs = F.zip_with(chars(a), chars(b), lambda x, y: (x == y) | ((x == F.lower(x)) & (x == F.lower(y))))
    return (F.length(a) == F.length(b)) & F.forall(pairs, lambda p: p)


# Characters


@arrow_udf(T.ArrayType(T.StringType()))
def graphemes(s: pa.Array) -> pa.Array:
    """The user-perceived characters of a text.

    One after the other they are the text, so that their bytes are those of the batch and only their bounds are made.
    """
    import regex

    clusters = regex.compile(r"\X")
    null, s = s.is_null(), s.cast(pa.string()).fill_null("")
    starts = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1] if len(s) else np.zeros(1, np.int32)
    bounds, counts = [starts[:1]], np.zeros(len(s) + 1, np.int32)
    for k, x in enumerate(s):
        t, size = x.as_py(), starts[k + 1] - starts[k]
        if len(t) == size and "\r" not in t:
            ends = np.arange(1, size + 1, dtype=np.int32)
        else:
            points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            places = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int32)
            ends = places[np.fromiter((m.end() for m in clusters.finditer(t)), np.int32) - 1]
        bounds.append(starts[k] + ends)
        counts[k + 1] = len(ends)
    flat = np.concatenate(bounds)
    values = pa.StringArray.from_buffers(len(flat) - 1, pa.py_buffer(flat), s.buffers()[2])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), values, mask=null)


@pandas_udf(T.IntegerType())
def display_width(s: pd.Series) -> pd.Series:
    """How many terminal columns a text takes: two for wide characters, none for combining ones."""
    import unicodedata

    def width(t: str) -> int:
        if t.isascii():
            return len(t)
        return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in t)

    return s.map(width, na_action="ignore").astype("Int32")


@pandas_udf(T.StringType())
def character_name(s: pd.Series) -> pd.Series:
    """Unicode's name of the first character."""
    import unicodedata

    return s.map(lambda t: unicodedata.name(t[0], None) if t else None, na_action="ignore")


@pandas_udf(T.StringType())
def punycode(s: pd.Series) -> pd.Series:
    """A host name in its ASCII form; null where it has none."""

    def ascii_form(t: str) -> str | None:
        try:
            return t.encode("idna").decode()
        except UnicodeError:
            return None

    return s.map(ascii_form, na_action="ignore")


def justify(s: Column, width: int) -> Column:
    """The words of a text with gaps that fill ``width``; gaps differ by one space at most, and the wider ones come first. A
    text of one word, or one that is too long, has single spaces."""
    found = F.array_remove(F.split(s, " +"), "")

    def spread(w: Column) -> Column:
        gaps = F.size(w) - 1
        extra = F.greatest(F.lit(width) - F.length(F.array_join(w, " ")), F.lit(0))
        gap = lambda i: F.lit(1) + F.floor(extra / gaps).cast("int") + F.when(i <= extra % gaps, 1).otherwise(0)
        return F.when(gaps < 1, F.array_join(w, " ")).otherwise(
            F.array_join(F.transform(w, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.repeat(F.lit(" "), gap(i)), x))), "")
        )

    return F.get(F.transform(F.array(found), spread), F.lit(0))
