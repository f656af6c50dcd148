"""Minimal edit scripts between sequences, hunks, patches, and the lives of lines over versions.

A script is an array of struct(op, left, right, value): ``keep`` with both positions, ``del`` with the left one, ``ins``
with the right one. Scripts of two arrays come from an Arrow-batched function, since each needs a search of its own;
everything on scripts is Column algebra.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

EDIT = T.StructType([T.StructField(n, t) for n, t in (("op", T.StringType()), ("left", T.IntegerType()), ("right", T.IntegerType()), ("value", T.StringType()))])
SCRIPT = T.ArrayType(EDIT)


def _reach(before: dict[int, int], k: int, n: int, m: int) -> int:
    """How far one more edit comes on diagonal ``k`` within n times m, or -1."""
    right, down = before.get(k - 1, -1), before.get(k + 1, -1)
    return max(right + 1 if 0 <= right < n else -1, down if 0 <= down <= m + k else -1)


def _snake(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
    """A run of equal items, perhaps empty, in the middle of a shortest script of two edits or more: its begin and end in both.
    The search goes from both ends at once, so that only the furthest reach on each diagonal is held."""
    n, m = len(a), len(b)
    odd, shift = (n - m) % 2, n - m
    ahead, back = {}, {}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            u = x = _reach(ahead, k, n, m) if d else 0
            while 0 <= x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            ahead[k] = x
            if odd and x >= 0 and back.get(shift - k, -1) >= max(n - x, 0) and abs(shift - k) < d:
                return u, u - k, x, x - k
        for k in range(-d, d + 1, 2):
            u = x = _reach(back, k, n, m) if d else 0
            while 0 <= x < n and x - k < m and a[n - 1 - x] == b[m - 1 - (x - k)]:
                x += 1
            back[k] = x
            if not odd and x >= 0 and ahead.get(shift - k, -1) >= max(n - x, 0) and abs(shift - k) <= d:
                return n - x, m - (x - k), n - u, m - (u - k)
    raise AssertionError("the searches meet after half of all edits")


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """The places of a longest common subsequence. What only one side has is left out first; a stack takes the place of
    recursion."""
    ours, theirs = set(a), set(b)
    left, right = [i for i, x in enumerate(a) if x in theirs], [j for j, y in enumerate(b) if y in ours]
    out, stack = [], [(0, len(left), 0, len(right))]
    while stack:
        i, k, j, m = stack.pop()
        while i < k and j < m and a[left[i]] == b[right[j]]:
            out.append((left[i], right[j]))
            i, j = i + 1, j + 1
        while i < k and j < m and a[left[k - 1]] == b[right[m - 1]]:
            k, m = k - 1, m - 1
            out.append((left[k], right[m]))
        if i < k and j < m:
            x, y, u, v = _snake([a[p] for p in left[i:k]], [b[q] for q in right[j:m]])
            out += [(left[i + x + s], right[j + y + s]) for s in range(u - x)]
            stack += [(i, i + x, j, j + y), (i + u, k, j + v, m)]
    return sorted(out)


def _script(a: list[str], b: list[str]) -> list[dict]:
    """A shortest script: between kept items what goes comes before what is new."""
    out, i, j = [], 0, 0
    for x, y in [*_matches(a, b), (len(a), len(b))]:
        out += [{"op": "del", "left": k, "right": None, "value": a[k]} for k in range(i, x)]
        out += [{"op": "ins", "left": None, "right": k, "value": b[k]} for k in range(j, y)]
        if x < len(a) and y < len(b):
            out.append({"op": "keep", "left": x, "right": y, "value": a[x]})
        i, j = x + 1, y + 1
    return out


@arrow_udf(SCRIPT)
def diff(a: pa.Array, b: pa.Array) -> pa.Array:
    """A shortest script that turns the first array of texts into the second. Only one row's script is held as objects."""
    kind = pa.struct([("op", pa.string()), ("left", pa.int32()), ("right", pa.int32()), ("value", pa.string())])
    made = [pa.array([None if x is None or y is None else _script(x, y)], pa.list_(kind)) for x, y in ((x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True))]
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(kind))


def size(script: Column) -> Column:
    """How many edits the script has."""
    return F.size(F.filter(script, lambda e: e["op"] != "keep"))


def flip(script: Column) -> Column:
    """The script the other way."""
    op = lambda e: F.when(e["op"] == "ins", "del").when(e["op"] == "del", "ins").otherwise(e["op"])
    return F.transform(script, lambda e: F.struct(op(e).alias("op"), e["right"].alias("left"), e["left"].alias("right"), e["value"].alias("value")))


def patch(script: Column) -> Column:
    """The right side."""
    return F.transform(F.filter(script, lambda e: e["op"] != "del"), lambda e: e["value"])


def original(script: Column) -> Column:
    """The left side."""
    return F.transform(F.filter(script, lambda e: e["op"] != "ins"), lambda e: e["value"])


def applies(script: Column, a: Column) -> Column:
    """Whether the script's left side is ``a``."""
    return original(script) == a


def hunks(df: DataFrame, key: list[str], script: str) -> DataFrame:
    """(key.., hunk, changed, left, right, removed, added) for each run of kept or of changed lines."""
    rows = df.select(*key, F.posexplode(script).alias("pos_", "e_"))
    w = Window.partitionBy(*key).orderBy("pos_")
    changed = F.col("e_.op") != "keep"
    flagged = rows.withColumn("changed", changed).withColumn("new_", F.when(F.col("changed").eqNullSafe(F.lag("changed").over(w)), 0).otherwise(1))
    numbered = flagged.withColumn("hunk", F.sum("new_").over(w) - 1)
    lines = lambda op: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("e_.op") == op, F.struct("pos_", "e_.value")))), lambda s: s["value"]
    )
    return numbered.groupBy(*key, "hunk", "changed").agg(
        F.min("e_.left").alias("left"), F.min("e_.right").alias("right"), lines("del").alias("removed"), lines("ins").alias("added")
    )


def unified(script: Column) -> Column:
    """A line per element: a space, a minus or a plus, and the value."""
    sign = lambda e: F.when(e["op"] == "keep", " ").when(e["op"] == "del", "-").otherwise("+")
    return F.array_join(F.transform(script, lambda e: F.concat(sign(e), e["value"])), "\n")


def evolve(versions: DataFrame, key: str, version: str, line: str) -> DataFrame:
    """(key, line, versions): in which versions each distinct line of a document is, ascending."""
    return versions.groupBy(key, line).agg(F.array_sort(F.collect_set(version)).alias("versions"))


def version_of(evolved: DataFrame, version: int) -> DataFrame:
    """The lines that a version has."""
    return evolved.filter(F.array_contains("versions", version))


def substitutions(script: Column, most: int) -> Column:
    """The script with deleted and inserted values at most ``most`` edits apart paired as ``sub``, in order, within each
    run of changes; a ``sub`` has both places and the new value."""

    @pandas_udf(SCRIPT)
    def pair(scripts: pd.Series) -> pd.Series:
        return scripts.map(lambda s: _paired([e if isinstance(e, dict) else e.asDict() for e in s], most), na_action="ignore")

    return pair(script)


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _paired(script: list[dict], most: int) -> list[dict]:
    out: list[dict] = []
    gone: list[dict] = []
    come: list[dict] = []

    def close() -> None:
        i = j = 0
        while i < len(gone) and j < len(come):
            if _edits(gone[i]["value"], come[j]["value"]) <= most:
                out.append({"op": "sub", "left": gone[i]["left"], "right": come[j]["right"], "value": come[j]["value"]})
                i, j = i + 1, j + 1
            elif len(gone) - i >= len(come) - j:
                out.append(gone[i])
                i += 1
            else:
                out.append(come[j])
                j += 1
        out.extend(gone[i:] + come[j:])
        gone.clear()
        come.clear()

    for e in script:
        if e["op"] == "keep":
            close()
            out.append(e)
        else:
            (gone if e["op"] == "del" else come).append(e)
    close()
    return out


def parse_unified(text: Column) -> Column:
    """The script of lines that begin with a space, a minus or a plus, without places."""
    op = lambda line: F.when(line.startswith("-"), "del").when(line.startswith("+"), "ins").otherwise("keep")
    nowhere = F.lit(None).cast("int")
    edit = lambda line: F.struct(op(line).alias("op"), nowhere.alias("left"), nowhere.alias("right"), F.substring(line, F.lit(2), F.length(line)).alias("value"))
    return F.when(text == "", F.array().cast("array<struct<op:string,left:int,right:int,value:string>>")).otherwise(F.transform(F.split(text, "\n", -1), edit))
