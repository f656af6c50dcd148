"""Further queries over tables: graphs, scripts, relations, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import diff as E
from loomstone.operators import graph as G
from loomstone.operators import lexicon, relational, sequence, sketch
from loomstone.plans.graphs import _REC, _S, _edges
from loomstone.plans.registry import Registry, table
from loomstone.session import shared_path
from loomstone.sources import delimited, files
from loomstone.streaming import events as V

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.add("q_graph_sources", f"WITH {_S} SELECT DISTINCT dst AS id FROM e WHERE dst NOT IN (SELECT src FROM e)")
def graph_sources(spark, sf_dir):
    return G.sources(_edges(spark, sf_dir))


@_R.add(
    "q_graph_lineage",
    f"{_REC} SELECT src, dst FROM e WHERE (src = 6 OR src IN (SELECT src FROM c WHERE dst = 6)) AND (dst = 6 OR dst IN (SELECT src FROM c WHERE dst = 6))"
    " UNION SELECT src, dst FROM e WHERE (src = 6 OR src IN (SELECT dst FROM c WHERE src = 6)) AND (dst = 6 OR dst IN (SELECT dst FROM c WHERE src = 6))",
)
def graph_lineage(spark, sf_dir):
    """All that leads to or from one vertex."""
    return G.lineage(_edges(spark, sf_dir), spark.createDataFrame([(6,)], "id int")).select("src", "dst")


@_R.add("q_graph_cycle", "SELECT false AS cyclic, true AS turned")
def graph_cycle(spark, sf_dir):
    """Whether the graph has a cycle, as it is and with an edge back."""
    edges = _edges(spark, sf_dir)
    turned = edges.unionByName(edges.limit(1).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return spark.createDataFrame([(G.has_cycle(edges), G.has_cycle(turned))], "cyclic boolean, turned boolean")


@_R.add(
    "q_graph_bridge",
    f"WITH {_S} SELECT src, dst FROM e WHERE src <> 6 AND dst <> 6 UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = 6 AND b.src = 6",
)
def graph_bridge(spark, sf_dir):
    """The graph without a vertex, its neighbours bridged."""
    return G.remove_vertex(_edges(spark, sf_dir), spark.createDataFrame([(6,)], "id int")).select("src", "dst")


@_R.add(
    "q_graph_fold",
    f"""
    WITH RECURSIVE {_S}, p(id, v) AS (SELECT id, id FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) UNION ALL SELECT p.id, e.dst FROM p JOIN e ON p.v = e.src)
    SELECT id, sum(v)::BIGINT AS total FROM p GROUP BY 1
    """,
)
def graph_fold(spark, sf_dir):
    """Each vertex's size and the totals of those it leads to."""
    edges = _edges(spark, sf_dir)
    values = G.vertices(edges).withColumn("value", F.col("id").cast("bigint"))
    return G.fold_up(edges, values).select("id", "total")


@_R.add(
    "q_order_bottom",
    f"WITH {_S} SELECT src AS low, dst AS high FROM e UNION SELECT 0, s FROM s",
)
def order_bottom(spark, sf_dir):
    """An order with an element below all others."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("id")).distinct()
    order = _edges(spark, sf_dir).select(F.col("src").alias("low"), F.col("dst").alias("high"))
    return G.with_bottom(sizes, order, 0)


def _scripts(spark, sf_dir):
    """A script for each part: its name's words against the same without the second and with a word more."""
    w = F.split("p_name", " ")
    b = F.concat(F.slice(w, 1, 1), F.slice(w, F.lit(3), F.size(w)), F.array(F.lit("zz")))
    rows = table(spark, sf_dir, "part").select("p_partkey", w.alias("a"), b.alias("b"))
    return rows.withColumn("s", E.diff("a", "b"))


_AB = """ab AS (SELECT p_partkey, string_split(p_name, ' ') AS a, list_concat(list_concat(string_split(p_name, ' ')[1:1], string_split(p_name, ' ')[3:]), ['zz']) AS b FROM part)"""


@_R.add(
    "q_scripts",
    f"""
    WITH {_AB} SELECT p_partkey, array_to_string(a, ' ') AS back, array_to_string(b, ' ') AS patched, array_to_string(b, ' ') AS flipped, true AS applies, false AS not_applies,
           array_to_string(a, ' ') AS parsed_left, array_to_string(b, ' ') AS parsed_right, 2 AS edits, array_to_string(b, ' ') AS paired FROM ab
    """,
)
def scripts(spark, sf_dir):
    """Scripts applied, turned, written, read and paired."""
    s = F.col("s")
    text = lambda a: F.array_join(a, " ")
    parsed = E.parse_unified(E.unified(s))
    paired = F.filter(E.substitutions(s, 0), lambda e: e["op"] != "del")
    return _scripts(spark, sf_dir).select(
        "p_partkey",
        text(E.original(s)).alias("back"),
        text(E.patch(s)).alias("patched"),
        text(E.original(E.flip(s))).alias("flipped"),
        E.applies(s, F.col("a")).alias("applies"),
        E.applies(s, F.col("b")).alias("not_applies"),
        text(E.original(parsed)).alias("parsed_left"),
        text(E.patch(parsed)).alias("parsed_right"),
        E.size(s).alias("edits"),
        text(F.transform(paired, lambda e: e["value"])).alias("paired"),
    )


@_R.add(
    "q_hunks",
    f"""
    WITH {_AB} SELECT p_partkey, 1::BIGINT AS hunk, a[2] AS removed, CASE WHEN len(a) = 2 THEN 'zz' ELSE '' END AS added FROM ab
    UNION ALL SELECT p_partkey, 3, '', 'zz' FROM ab WHERE len(a) > 2
    """,
)
def hunks(spark, sf_dir):
    """The runs of changed words in each script."""
    found = E.hunks(_scripts(spark, sf_dir), ["p_partkey"], "s").filter("changed")
    return found.select("p_partkey", "hunk", F.array_join("removed", " ").alias("removed"), F.array_join("added", " ").alias("added"))


@_R.add("q_version_of", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate::DATE) = 1995")
def version_of(spark, sf_dir):
    """What one year's version of each customer's statuses has."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.year(F.to_date("o_orderdate")).alias("y"), "o_orderstatus")
    return E.version_of(E.evolve(rows, "o_custkey", "y", "o_orderstatus"), 1995).select("o_custkey", "o_orderstatus")


@_R.add("q_establish", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new ' || c_custkey END AS c_name FROM customer")
def establish(spark, sf_dir):
    """Values that are known, or else computed."""
    customer = table(spark, sf_dir, "customer")
    known = customer.filter("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return relational.establish(known, customer.select("c_custkey"), ["c_custkey"], "c_name", F.concat(F.lit("new "), F.col("c_custkey").cast("string"))).select("c_custkey", "c_name")


@_R.add("q_references", "SELECT c_custkey, c_mktsegment AS back, dense_rank() OVER (ORDER BY c_mktsegment) AS ref FROM customer")
def references(spark, sf_dir):
    """Values as references and back."""
    values = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    entities = relational.store(values, ["c_mktsegment"])
    refs = relational.reference(values, entities, ["c_mktsegment"]).select("c_custkey", "ref")
    return relational.dereference(refs, entities).select("c_custkey", F.col("c_mktsegment").alias("back"), "ref")


@_R.add(
    "q_collate_nulls",
    """
    WITH a AS (SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT nullif(s_nationkey, 3) AS k, count(*) AS n FROM supplier GROUP BY 1)
    SELECT k, sum(n)::BIGINT AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1
    """,
)
def collate_nulls(spark, sf_dir):
    """Counts of two tables merged by a key that may be null."""
    count = lambda t, c: table(spark, sf_dir, t).groupBy(F.nullif(F.col(c), F.lit(3)).alias("k")).agg(F.count("*").alias("n"))
    return relational.collate(count("customer", "c_nationkey"), count("supplier", "s_nationkey"), ["k"], "n", lambda a, b: a + b)


@_R.add("q_partition_rows", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS yes, (SELECT count(*) FROM customer WHERE NOT coalesce(c_acctbal > 0, false)) AS no, (SELECT count(*) FROM customer) AS shuffled")
def partition_rows(spark, sf_dir):
    """The rows that satisfy a condition, those that do not, and all in a random order."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    yes, no = sequence.partition(customer, F.col("c_acctbal") > 0)
    tagged = yes.select(F.lit("yes").alias("t")).unionByName(no.select(F.lit("no").alias("t"))).unionByName(sequence.shuffled(customer, 3).select(F.lit("shuffled").alias("t")))
    return tagged.agg(*[F.count_if(F.col("t") == t).alias(t) for t in ("yes", "no", "shuffled")])


@_R.add(
    "q_approximate",
    "SELECT l_returnflag, true AS close, true AS near, true AS alike FROM (SELECT DISTINCT l_returnflag FROM lineitem)",
)
def approximate(spark, sf_dir):
    """Approximate counts and medians stay within a tenth of the exact ones."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey")
    exact = lines.groupBy(F.col("l_returnflag").alias("f")).agg(F.countDistinct("l_orderkey").alias("n"), F.median("l_orderkey").alias("m"))
    found = sketch.approximate(lines, ["l_returnflag"], "l_orderkey").join(exact, F.col("f") == F.col("l_returnflag"))
    within = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.1 * F.col(b)
    return found.select("l_returnflag", within("distinct", "n").alias("close"), within("median", "m").alias("near"), within("hll", "n").alias("alike"))


@_R.add("q_trie_lookup", "SELECT c_custkey, CASE WHEN c_nationkey < 9 THEN n_name END AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def trie_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").filter("n_nationkey < 9").select("n_nationkey", F.col("n_name").alias("nation"))
    return lexicon.trie_lookup(table(spark, sf_dir, "customer"), "c_nationkey", names, "n_nationkey").select("c_custkey", "nation")


@_R.add("q_delimited_files", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name || ', \"' || r_name || '\"' AS r_name FROM region")
def delimited_files(spark, sf_dir):
    """Cells with quotes, delimiters and headings, written and read back."""
    path = shared_path(spark, "delimited")
    text = F.concat("r_name", F.lit(', "'), "r_name", F.lit('"'))
    delimited.write(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("r_regionkey"), text.alias("r_name")), path)
    return delimited.read_text_cells(spark, path, delimited.CSV_WITH_HEADER)


@_R.add("q_misplaced_quotes", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN length(p_name) + 2 END AS misplaced FROM part")
def misplaced_quotes(spark, sf_dir):
    """Where a quote opens inside a cell."""
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("1,"), F.col("p_name"), F.lit('"x"'))).otherwise(F.concat(F.lit('"1",'), F.col("p_name")))
    lines = table(spark, sf_dir, "part").select("p_partkey", line.alias("value"))
    return delimited.misplaced_quotes(lines).select("p_partkey", F.col("misplaced").cast("long").alias("misplaced"))


@_R.add("q_whole_files", "SELECT r_name AS whole, r_name AS latin, r_name AS line FROM region")
def whole_files(spark, sf_dir):
    """A file for each region, read whole, in a charset and by lines."""
    path = shared_path(spark, "texts")
    names = table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").alias("part"))
    files.write(names.repartition(5, "part"), path, "text", by=("part",))
    name = F.regexp_extract("path", "part=([^/]*)", 1)
    whole = files.documents(spark, f"{path}/*/*.txt").select(name.alias("n"), F.rtrim(F.col("text"), F.lit("\n")).alias("whole"))
    latin = files.decoded(spark, f"{path}/*/*.txt", "ISO-8859-1").select(name.alias("m"), F.rtrim(F.col("text"), F.lit("\n")).alias("latin"))
    lines = files.lines(spark, f"{path}/*/*.txt").select(F.col("value").alias("line"))
    return whole.join(latin, F.col("n") == F.col("m")).join(lines, F.col("whole") == F.col("line")).select("whole", "latin", "line")


@_R.add("q_read_write", "SELECT n_nationkey, n_name FROM nation")
def read_write(spark, sf_dir):
    """A table through JSON lines and back."""
    path = shared_path(spark, "nations")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    files.write(nations, f"{path}/n.jsonl", "json")
    return files.read(spark, f"{path}/n.jsonl", schema=nations.schema)


@_R.add("q_stream_files", "SELECT event_id, user_id FROM events")
def stream_files(spark, sf_dir):
    """A stream of files written on as files."""
    path, schema = shared_path(spark, "flow"), table(spark, sf_dir, "events").select("event_id", "user_id").schema
    files.flow(table_stream(spark, sf_dir), f"{path}/rows", f"{path}/checkpoint").processAllAvailable()
    return spark.read.schema(schema).parquet(f"{path}/rows")


def table_stream(spark, sf_dir):
    return V.replay(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema).select("event_id", "user_id")


@_R.add("q_stream_distinct", "SELECT DISTINCT user_id FROM events")
def stream_distinct(spark, sf_dir):
    """The first event of each user of a stream that brings all of them twice."""
    make = lambda: V.replay(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = V.distinct_events(V.merge(make(), make()), ["user_id"], "ts", "3650 days")
    return V.run_to_end(found, spark, shared_path(spark, "stream-distinct")).select("user_id")


@_R.add("q_stream_fan_out", "SELECT event_id, event_id % 2 = 0 AS even FROM events")
def stream_fan_out(spark, sf_dir):
    """Each batch of a stream handed to two sinks."""
    path = shared_path(spark, "fan-out")
    sink = lambda name, keep: lambda batch, n: batch.filter(keep).write.mode("overwrite").parquet(f"{path}/{name}/{n}")
    query = V.fan_out(table_stream(spark, sf_dir), [sink("even", "event_id % 2 = 0"), sink("odd", "event_id % 2 <> 0")], f"{path}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    schema = table(spark, sf_dir, "events").select("event_id", "user_id").schema
    read = lambda name: spark.read.schema(schema).parquet(f"{path}/{name}/*").select("event_id", F.lit(name == "even").alias("even"))
    return read("even").unionByName(read("odd"))
