"""Further calendars, texts of dates, compression, permutations and edit scripts."""

import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from loomstone.functions import codec as K
from loomstone.functions import collections as C
from loomstone.functions import nested as J
from loomstone.functions import numeric as N
from loomstone.functions import random as Z
from loomstone.functions import temporal as D
from loomstone.operators import diff, lexicon
from loomstone.sources import delimited


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# Known days: new years and leap days of each calendar.
DAYS = [
    (D.hebrew, "2023-09-16", (5784, 1, 1)),
    (D.hebrew, "2024-10-03", (5785, 1, 1)),
    (D.hebrew, "2024-04-23", (5784, 8, 15)),
    (D.hebrew, "2023-04-06", (5783, 7, 15)),
    (D.hebrew, "2000-09-30", (5761, 1, 1)),
    (D.persian, "2024-03-20", (1403, 1, 1)),
    # The arithmetic puts the leap day of 1403, as observed, into 1404.
    (D.persian, "2025-03-20", (1404, 1, 1)),
    (D.persian, "2026-03-20", (1404, 12, 30)),
    (D.persian, "2000-01-01", (1378, 10, 11)),
    (D.french_republican, "1792-09-22", (1, 1, 1)),
    (D.french_republican, "1794-07-27", (2, 11, 9)),
    (D.french_republican, "1795-09-22", (3, 13, 6)),
    (D.french_republican, "1799-11-09", (8, 2, 18)),
]


@pytest.mark.parametrize("calendar,day,want", DAYS)
def test_calendar(spark, calendar, day, want):
    assert tuple(one(spark, calendar(F.lit(day).cast("date")))) == want


@pytest.mark.parametrize("calendar", [D.hebrew, D.persian, D.french_republican])
def test_days_follow_one_another(spark, calendar):
    days = spark.sql("SELECT explode(sequence(DATE '1995-01-01', DATE '2006-12-31')) AS d").select("d", calendar(F.col("d")).alias("c")).orderBy("d").collect()
    for a, b in zip(days, days[1:]):
        (y, m, n), (y2, m2, n2) = tuple(a.c), tuple(b.c)
        assert (y2, m2, n2) == (y, m, n + 1) or (n2 == 1 and ((y2, m2) == (y, m + 1) or (y2, m2) == (y + 1, 1))), (a, b)


INSTANTS = [
    ("2024-02-29", "2024-02-29 00:00:00"),
    ("20240229", "2024-02-29 00:00:00"),
    ("2024-02-29T12:34:56.5Z", "2024-02-29 12:34:56.5"),
    ("2024-02-29T12:34:56+02:00", "2024-02-29 10:34:56"),
    ("2025-W01-1", "2024-12-30 00:00:00"),
    ("2024-060", "2024-02-29 00:00:00"),
    ("Thu, 29 Feb 2024 12:34:56 GMT", "2024-02-29 12:34:56"),
    ("2024-02-30", None),
    ("nonsense", None),
]


@pytest.mark.parametrize("text,want", INSTANTS)
def test_instants(spark, text, want):
    assert one(spark, D.parse_instant(F.lit(text)).cast("string")) == want


def test_names_rules_and_timelines(spark):
    day = F.lit("2024-02-29").cast("date")
    assert one(spark, F.concat_ws(" ", D.weekday_name(day, "de"), D.month_name(day, "fr"))) == "Donnerstag février"
    assert all(one(spark, F.date_format(F.lit("2024-02-29 15:04:05").cast("timestamp"), p)) for p in (*D.DATE_FORMATS.values(), *D.TIME_FORMATS.values()))
    parts = D.rule_parts("RRULE:FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1;COUNT=3")
    found = one(spark, D.rule(F.lit("2024-01-01").cast("date"), until=F.lit("2024-12-31").cast("date"), **parts))
    assert found == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 29)]
    for t in ("2016-12-31 23:59:59", "2017-01-01 00:00:00", "1990-05-05 01:02:03"):
        instant = F.lit(t).cast("timestamp")
        assert one(spark, D.from_tai(D.to_tai(instant)).cast("string")) == t


@pytest.mark.parametrize("algorithm", ["gzip", "zlib", "deflate", "bzip2", "xz"])
def test_compression(spark, algorithm):
    df = spark.createDataFrame([(bytearray(b"abc" * 100),), (bytearray(b""),), (None,)], "b binary")
    back = [r[0] for r in df.select(K.decompress(K.compress(F.col("b"), algorithm), algorithm)).collect()]
    assert back == [b"abc" * 100, b"", None]
    assert spark.range(1).select(K.decompress(F.lit("junk").cast("binary"), algorithm)).first()[0] is None


@pytest.mark.parametrize("n", [1, 4])
def test_permutations(spark, n):
    got = [r.p for r in spark.range(math.factorial(n)).select("id", C.permutation(F.col("id"), n).alias("p")).orderBy("id").collect()]
    assert got == [list(p) for p in itertools.permutations(range(n))]


def test_substitutions_and_unified_texts(spark):
    old, new = ["uno", "due", "tre", "x"], ["uno", "dos", "tres", "y", "x"]
    df = spark.createDataFrame([(old, new)], "a array<string>, b array<string>").select(diff.diff("a", "b").alias("s"))
    paired = [(e.op, e.value) for e in df.select(diff.substitutions(F.col("s"), 3)).first()[0]]
    assert paired == [("keep", "uno"), ("sub", "dos"), ("sub", "tres"), ("ins", "y"), ("keep", "x")]
    again = df.select(diff.parse_unified(diff.unified(F.col("s"))).alias("p")).select(diff.patch(F.col("p")), diff.original(F.col("p"))).first()
    assert tuple(again) == (new, old)


def test_numbers(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    held = spark.range(1).select(F.array(v(2.0, 1.0), v(1.0, 3.0)).alias("m"))
    odd = spark.range(1).select(F.array(v(2.0, 1.0), v(0.0, 3.0)).alias("m"), F.array(v(1.0, 2.0), v(2.0, 4.0)).alias("s"), F.array(v(0.0, -1.0), v(1.0, 0.0)).alias("r"))
    found = odd.select(N.eigenvectors("m").alias("e"), N.adjugate("s").alias("a"), N.eigenvectors("r").alias("n")).first()
    assert found.e == [[1, 0], [pytest.approx(0.5**0.5)] * 2] and found.n is None
    assert [[round(x, 9) for x in r] for r in found.a] == [[4, -2], [-2, 1]]
    row = held.select(N.adjugate("m").alias("a"), N.eigenvectors("m").alias("e")).first()
    assert [[round(x, 9) for x in r] for r in row.a] == [[3, -1], [-1, 2]] and abs(sum(x * x for x in row.e[0]) - 1) < 1e-9
    z = F.struct(F.lit(0.0).alias("re"), F.lit(2.0).alias("im"))
    assert tuple(one(spark, N.multiply_complex(z, z))) == (-4, 0) and tuple(round(x, 9) for x in one(spark, N.complex_sqrt(z))) == (1, 1)
    assert one(spark, N.mixed_radix(F.lit(93784), [24, 60, 60])) == [1, 2, 3, 4]
    assert [one(spark, N.decimalize(F.lit(x), 3)) for x in (1234.5, 0.0012345, 0.0, -99999.0)] == [1230.0, 0.00123, 0.0, -100000.0]


def test_random_columns_repeat_with_their_seed(spark):
    df = spark.range(500, numPartitions=2)
    cols = [Z.uniform(3), Z.gaussian(3), Z.toss(3), Z.whole(3), Z.pick(3, ["a", "b"]), Z.gamma(F.col("id"), 2.0)]
    assert df.select(*cols).collect() == df.select(*cols).collect()
    share = df.select(Z.toss(1).cast("int").alias("t"), Z.gamma(F.col("id"), 2.0).alias("g")).agg(F.avg("t"), F.avg("g")).first()
    assert 0.4 < share[0] < 0.6 and 1.7 < share[1] < 2.3


def test_terms_and_prefixes(spark):
    df = spark.createDataFrame([(1, "éushers"), (2, None), (3, "")], "i int, t string")
    got = {r.i: [tuple(h) for h in r.found] for r in lexicon.multi_search(df, "t", "i", ["he", "she", "hers", ""]).collect()}
    assert got == {1: [(2, 5, "she"), (3, 5, "he"), (3, 7, "hers")], 2: [], 3: []}
    assert [r.found for r in lexicon.multi_search(df, "t", "i", []).collect()] == [[], [], []]
    long = spark.createDataFrame([(1, "é" + "ab" * 3000), (2, "x" * 5000)], "i int, t string")
    hits = {r.i: [h.start for h in r.found] for r in lexicon.multi_search(long, "t", "i", ["baba"]).collect()}
    assert hits == {1: [2 * k + 2 for k in range(2998)], 2: []}
    table = spark.createDataFrame([("e", 1), ("éu", 2), ("", 0)], "p string, v int")
    assert {r.i: r.v for r in lexicon.longest_prefix(df, "t", table, "p", "v").collect()} == {1: 2, 2: None, 3: 0}
    assert lexicon.trie_lookup(df, "t", table, "p").count() == 3


def test_json_and_cells(spark):
    assert one(spark, J.json_equal(F.lit('{"a": [5.0, "x"], "b": null}'), F.lit('{"b":null,"a":[5,"x"]}'))) is True
    assert one(spark, J.json_equal(F.lit("[1, 2]"), F.lit("[2, 1]"))) is False
    assert [one(spark, J.json_kind(F.lit(s))) for s in ("{}", "[]", '"x"', "1", "1.5", "true", "null", "{")] == ["object", "array", "string", "number", "number", "boolean", "null", None]
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    assert [r.v for r in delimited.update(df, "v", lambda c: F.concat(c, F.lit("!")), F.col("k") == "b").collect()] == ["1", "2!"]
    patched = one(spark, J.merge_patch(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("3"))))
    assert patched == {"b": "2", "c": "3"}
