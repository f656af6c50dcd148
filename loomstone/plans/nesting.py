"""Queries over nested values, JSON, XML, delimited text and edit scripts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions import nested as J
from loomstone.operators import diff
from loomstone.plans.registry import Registry, dealt, table
from loomstone.sources import delimited

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.add("q_json_get", "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.missing' AS missing FROM events")
def json_get(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", J.json_at(p, "/k").cast("long").alias("k"), J.json_at(p, "/missing").alias("missing"))


@_R.add("q_json_variant", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_variant(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.variant_at(F.parse_json("props"), "/k", "bigint").alias("k"))


@_R.add("q_json_update", "SELECT event_id, (props->>'$.k')::BIGINT + 1 AS k, 'x' AS tag FROM events")
def json_update(spark, sf_dir):
    """A field of parsed JSON changed and another set, then read back from text."""
    s = F.from_json("props", "k bigint, tag string")
    new = F.to_json(J.assign(J.modify(s, ["k"], lambda k: k + 1), [(["tag"], "x")]))
    return table(spark, sf_dir, "events").select("event_id", J.json_at(new, "/k").cast("long").alias("k"), J.json_at(new, "/tag").alias("tag"))


_SCHEMA = {
    "type": "object",
    "required": ["k", "name"],
    "properties": {"k": {"type": "integer", "maximum": 50}, "name": {"type": "string"}},
}


@_R.add(
    "q_json_verify",
    "SELECT event_id, (1 + ((props->>'$.k')::BIGINT > 50)::INT)::BIGINT AS n_errors FROM events",
)
def json_verify(spark, sf_dir):
    """How much is wrong with each document under a JSON Schema: ``name`` is missing from all."""
    return table(spark, sf_dir, "events").select("event_id", F.size(J.verify(F.col("props"), _SCHEMA)).cast("long").alias("n_errors"))


@_R.add(
    "q_optics",
    """
    SELECT o_custkey, sum(CASE WHEN o_totalprice > 200000 THEN floor(o_totalprice)::BIGINT * 2 ELSE floor(o_totalprice)::BIGINT END)::BIGINT AS total,
           max(o_totalprice)::DOUBLE AS most FROM orders GROUP BY 1
    """,
)
def optics(spark, sf_dir):
    """Prices deep in an array of structs doubled where they are high."""
    item = F.struct(F.floor("o_totalprice").alias("price"), F.col("o_totalprice").alias("exact"))
    nested = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.struct(F.collect_list(item).alias("items")).alias("c"))
    high = J.matching(lambda x: x["exact"] > 200000)
    changed = J.modify(F.col("c"), ["items", high, "price"], lambda p: p * 2)
    prices, exact = J.get(changed, ["items", J.each(), "price"]), J.get(changed, ["items", J.each(), "exact"])
    total = F.aggregate(prices, F.lit(0).cast("long"), lambda s, x: s + x)
    return nested.select("o_custkey", total.alias("total"), F.array_max(exact).alias("most"))


@_R.add("q_xpath", "SELECT n_nationkey, n_name AS name, n_regionkey::DOUBLE AS region, true AS same FROM nation")
def xpath(spark, sf_dir):
    """Values out of XML text."""
    xml = F.format_string('<nation region="%s"><name>%s</name></nation>', "n_regionkey", "n_name")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        J.xml_at(xml, "/nation/name").alias("name"),
        J.xml_at(xml, "/nation/@region", "number").alias("region"),
        J.xml_at(xml, "count(/nation/name) = 1", "boolean").alias("same"),
    )


@_R.add(
    "q_dsv_line",
    """
    SELECT p_partkey, CASE WHEN contains(p_name, ',') OR contains(p_name, '"') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END
           || ',' || p_size || ',"a ""q"", b"' AS line FROM part
    """,
)
def dsv_line(spark, sf_dir):
    """Rows as delimited lines; only cells that need it are quoted."""
    cells = F.array("p_name", F.col("p_size").cast("string"), F.lit('a "q", b'))
    return table(spark, sf_dir, "part").select("p_partkey", delimited.to_line(cells).alias("line"))


_ROW = T.StructType(
    [T.StructField("partKey", T.LongType(), False), T.StructField("size", T.IntegerType(), False), T.StructField("note", T.StringType(), True)]
)


@_R.add(
    "q_dsv_decode",
    """
    SELECT p_partkey AS "partKey", CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END::INT AS size, (p_size % 5 = 0)::INT::BIGINT AS n_errors FROM part
    """,
)
def dsv_decode(spark, sf_dir):
    """Cells by heading as a typed record; each cell that does not parse is an error of its row."""
    cells = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("part key"),
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("n"), F.col("p_size"))).otherwise(F.col("p_size").cast("string")).alias("size"),
    )
    return delimited.decode(cells, _ROW, "lower_words").select("partKey", "size", F.size("errors").cast("long").alias("n_errors"))


@_R.add("q_diff_lines")
def diff_lines(spark, sf_dir):
    """A shortest edit script between the lines of neighbouring turns of a conversation; tests hold it against a plain search."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    found = dealt(turns.join(after, ["conv_id", "turn"])).withColumn("script", diff.diff(F.col("a"), F.col("b")))
    return found.select("conv_id", "turn", diff.size(F.col("script")).alias("edits"), (diff.patch(F.col("script")) == F.col("b")).alias("right"))


@_R.add(
    "q_evolve",
    """
    WITH w AS (SELECT conv_id, turn, unnest(list_distinct(string_split(text, ' '))) AS line FROM conversations)
    SELECT conv_id, line, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS versions FROM (SELECT DISTINCT conv_id, turn, line FROM w) GROUP BY 1, 2
    """,
)
def evolve(spark, sf_dir):
    """In which turns of its conversation each word is."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ", -1)).alias("line"))
    return diff.evolve(w, "conv_id", "turn", "line").withColumn("versions", F.array_join(F.col("versions").cast("array<string>"), ","))
