"""Files, delimited text, archives and streams."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.sources import delimited as D
from loomstone.sources import files
from loomstone.streaming import events as E


def write(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


CELLS = [
    ("a,b\n", [["a", "b"]]),
    ('"a","b"\n', [["a", "b"]]),
    (",b\n", [[None, "b"]]),
    ('"a,b",c\r\n', [["a,b", "c"]]),
    ('"say ""x""",c\n', [['say "x"', "c"]]),
    ('"two\nlines",c\nd,e\n', [["two\nlines", "c"], ["d", "e"]]),
    ("a,b\n\nc,d\n", [["a", "b"], ["c", "d"]]),
]


@pytest.mark.parametrize("text,want", CELLS)
def test_cells(spark, tmp_path, text, want):
    path = write(tmp_path / "x.csv", text)
    assert [list(r) for r in D.read_text_cells(spark, path, columns=["x", "y"]).collect()] == want


def test_formats_and_headings(spark, tmp_path):
    tsv = D.read_text_cells(spark, write(tmp_path / "x.tsv", "target person\tgreeting\nworld\thello\n"), D.TSV_WITH_HEADER)
    schema = T.StructType([T.StructField("greeting", T.StringType()), T.StructField("targetPerson", T.StringType())])
    assert tuple(D.decode(tsv, schema, "lower_words").first())[:2] == ("hello", "world")
    assert [D.RENAMES[n]("targetPerson") for n in D.RENAMES] == ["targetPerson", "target person", "target.person", "target/person", "Target Person"]
    twice = D.read_text_cells(spark, write(tmp_path / "y.csv", "a,a\n1,2\n"), D.CSV_WITH_HEADER)
    assert twice.select(D.cell(twice, "a")).first()[0] == "2"


def test_errors_of_a_row_are_gathered(spark, tmp_path):
    path = write(tmp_path / "x.csv", "name,age,height\nann,x,y\nbob,3,\ncid,4,5\n")
    kinds = (("name", T.StringType()), ("age", T.IntegerType()), ("height", T.IntegerType()))
    schema = T.StructType([T.StructField(n, t, False) for n, t in kinds])
    got = {r.name: r.errors for r in D.decode(D.read_text_cells(spark, path, D.CSV_WITH_HEADER), schema).collect()}
    assert [len(got[n]) for n in ("ann", "bob", "cid")] == [2, 1, 0] and got["bob"] == ["height: missing"]


def test_nested_records_span_cells(spark, tmp_path):
    foo = T.StructType([T.StructField("one", T.StringType()), T.StructField("two", T.StringType())])
    bar = T.StructType([T.StructField("one", T.DoubleType()), T.StructField("foo1", foo), T.StructField("four", T.IntegerType()), T.StructField("foo2", foo)])
    df = D.decode(D.read_text_cells(spark, write(tmp_path / "x.csv", "0.1,a,b,4,c,d\n")), bar)
    row = df.first()
    assert (row.one, tuple(row.foo1), row.four, tuple(row.foo2), row.errors) == (0.1, ("a", "b"), 4, ("c", "d"), [])
    from loomstone.functions.nested import flatten_record

    assert list(df.select(*flatten_record(bar)).first()) == [0.1, "a", "b", 4, "c", "d"]


def test_lines_out_and_back(spark, tmp_path):
    rows = [("a,b", 'q"q', "two\nlines", None), ("plain", "", "x", "y")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert df.select(D.to_line(F.array("a", "b", "c", "d"))).first()[0] == '"a,b","q""q","two\nlines",'
    D.write(df.coalesce(1), str(tmp_path / "out"))
    again = D.read_text_cells(spark, str(tmp_path / "out"), D.CSV_WITH_HEADER)
    assert [r.a for r in again.collect()] == ["a,b", "plain"]
    bad = spark.createDataFrame([('a,w"r',), ('"ok",b',), ("x,y",)], "value string")
    assert [r.misplaced for r in D.misplaced_quotes(bad).collect()] == [3, None, None]


def test_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    write(tmp_path / "docs/a.txt", "one\ntwo")
    write(tmp_path / "docs/b.txt", "é".encode("latin-1"))
    assert files.lines(spark, str(tmp_path / "docs/a.txt")).count() == 2
    assert files.documents(spark, str(tmp_path / "docs/a.txt")).first().text == "one\ntwo"
    assert files.decoded(spark, str(tmp_path / "docs/b.txt"), "ISO-8859-1").first().text == "é"
    df = spark.range(5)
    for kind in ("parquet", "orc", "json"):
        files.write(df, str(tmp_path / f"x.{kind}"), kind)
        assert files.read(spark, str(tmp_path / f"x.{kind}")).count() == 5
    assert files.render(df.filter("id < 2")).split("\n")[1] == "│ id │"


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        info = tarfile.TarInfo("d/a.txt")
        info.size, info.mtime = 3, 1_700_000_000
        t.addfile(info, io.BytesIO(b"abc"))
    write(tmp_path / "x.tar.gz", buffer.getvalue())
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("b.txt", "hello")
    got = sorted((r.name, r.size, bytes(r.content)) for r in files.archives(spark, str(tmp_path)).collect())
    assert got == [("b.txt", 5, b"hello"), ("d/a.txt", 3, b"abc")]


def stamped(spark, rows):
    return spark.createDataFrame(rows, "k string, s string, v double").select("k", F.col("s").cast("timestamp").alias("ts"), "v")


ROWS = [("a", f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 5, 14, 15, 40)] + [("b", "2024-01-01 00:07:00", 2.0)]


def test_event_windows(spark):
    df, n = stamped(spark, ROWS), [F.count("*").alias("n")]
    tumbling = E.tumbling(df, "ts", "15 minutes", ["k"], n).orderBy("k", "start").collect()
    assert [(r.k, r.n) for r in tumbling] == [("a", 3), ("a", 1), ("a", 1), ("b", 1)]
    sessions = E.sessions(df, "ts", "10 minutes", ["k"], n).orderBy("k", "start").collect()
    assert [(r.k, r.n) for r in sessions] == [("a", 4), ("a", 1), ("b", 1)]
    assert E.sliding(df, "ts", "30 minutes", "15 minutes", [], n).agg(F.sum("n")).first()[0] == 12


def test_streams_end_with_what_tables_give(spark, tmp_path):
    df = stamped(spark, ROWS)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: E.replay(spark, str(tmp_path / "in"), df.schema)
    n = [F.count("*").alias("n")]
    found = E.run_to_end(E.tumbling(read(), "ts", "15 minutes", ["k"], n, "1 hour"), spark, str(tmp_path / "c1"), "complete")
    want = E.tumbling(df, "ts", "15 minutes", ["k"], n)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    folded = E.run_to_end(E.gather(read(), "k", "v", lambda s, x: s + x, 0.0), spark, str(tmp_path / "c2"), "update")
    assert dict(map(tuple, folded.groupBy("k").agg(F.max("state")).collect())) == {"a": 5.0, "b": 2.0}
    merged = E.run_to_end(E.merge(read().select("v"), read().select("v")), spark, str(tmp_path / "c3"))
    assert merged.count() == 12
    unique = E.run_to_end(E.distinct_events(E.merge(read(), read()), ["k", "ts"], "ts", "1 day"), spark, str(tmp_path / "c4"))
    assert unique.count() == 6


def test_fan_out(spark, tmp_path):
    df = stamped(spark, ROWS)
    df.write.parquet(str(tmp_path / "in"))
    seen = {"a": 0, "b": 0}

    def sink(name):
        def take(batch, number):
            seen[name] += batch.count()

        return take

    query = E.fan_out(E.replay(spark, str(tmp_path / "in"), df.schema, 10), [sink("a"), sink("b")], str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert seen == {"a": 6, "b": 6}
