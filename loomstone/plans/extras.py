"""Queries over term search, prefixes, mixed units and JSON equality."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import nested as J
from loomstone.functions import numeric as N
from loomstone.functions import random as Z
from loomstone.operators import lexicon
from loomstone.plans.registry import Registry, dealt, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
_TERMS = ["tion", "the", "onthe", "he", "idiot"]


@_R.add(
    "q_multi_search",
    f"""
    WITH t AS (SELECT unnest({_TERMS}) AS term),
         p AS (SELECT doc_id, term, list_transform(string_split(text, term), lambda x: length(x)) AS gaps FROM documents, t),
         h AS (SELECT doc_id, term, unnest(range(1, len(gaps))) AS k, gaps FROM p)
    SELECT doc_id, count(*) AS n, sum(list_sum(gaps[1:k]) + (k - 1) * length(term))::BIGINT AS starts, count(DISTINCT term) AS terms FROM h GROUP BY 1
    """,
)
def multi_search(spark, sf_dir):
    """All places of several terms, overlaps included."""
    found = lexicon.multi_search(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", _TERMS)
    # Below explode() the planner puts a filter on the array's size, for which each text would be searched twice.
    hits = found.select("doc_id", F.explode_outer("found").alias("h")).filter("h IS NOT NULL")
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("h.start").cast("long")).alias("starts"), F.countDistinct("h.term").alias("terms"))


@_R.add(
    "q_longest_prefix",
    """
    WITH w AS (SELECT unnest(['b', 'bl', 'blu', 'g', 'gre', 'p', 'pal']) AS w)
    SELECT p_partkey, max_by(w, length(w)) AS w FROM part LEFT JOIN w ON starts_with(p_name, w) GROUP BY 1
    """,
)
def longest_prefix(spark, sf_dir):
    """The longest listed prefix of each name."""
    words = spark.sql("SELECT explode(array('b', 'bl', 'blu', 'g', 'gre', 'p', 'pal')) AS w").withColumn("v", F.col("w"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lexicon.longest_prefix(parts, "p_name", words, "w", "v").select("p_partkey", F.col("v").alias("w"))


@_R.add(
    "q_mixed_radix",
    "SELECT o_orderkey, o_orderkey * 97 // 86400 AS d, o_orderkey * 97 // 3600 % 24 AS h, o_orderkey * 97 // 60 % 60 AS m, o_orderkey * 97 % 60 AS s FROM orders",
)
def mixed_radix(spark, sf_dir):
    """Seconds as days, hours, minutes and seconds."""
    parts = N.mixed_radix(F.col("o_orderkey") * 97, [24, 60, 60])
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate("dhms")])


@_R.add("q_json_equal", "SELECT event_id, true AS same, false AS other, 'object' AS kind FROM events")
def json_equal(spark, sf_dir):
    """Equality of JSON whatever the order of keys and the way numbers are written."""
    k = F.get_json_object("props", "$.k")
    a, b = F.format_string('{"x": 1, "k": %s.0}', k), F.format_string('{"k":%s,"x":1.00}', k)
    return table(spark, sf_dir, "events").select(
        "event_id", J.json_equal(a, b).alias("same"), J.json_equal(a, F.col("props")).alias("other"), J.json_kind(F.col("props")).alias("kind")
    )


@_R.add("q_xml_struct", "SELECT r_regionkey, r_name AS name, r_regionkey AS key FROM region")
def xml_struct(spark, sf_dir):
    """Rows as XML text and back as structs."""
    text = J.to_xml(F.struct(F.col("r_regionkey").alias("_key"), F.col("r_name").alias("name")), "region")
    back = table(spark, sf_dir, "region").select("r_regionkey", J.xml_struct(text, "_key int, name string").alias("x"))
    return back.select("r_regionkey", F.col("x.name").alias("name"), F.col("x._key").alias("key"))


@_R.add("q_random", "SELECT count(*) AS n, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS deviation, 0.5::DOUBLE AS half, 2.0::DOUBLE AS gamma, 0::BIGINT AS outside FROM lineitem")
def random(spark, sf_dir):
    """Random columns have the moments that their distributions state, to a tenth, and stay within their bounds."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")).select(Z.uniform(1, 2, 3).alias("u"), Z.gaussian(5).alias("z"), Z.gamma(key, 2.0).alias("g"))
    tenth = lambda x: F.round(F.round(x * 5) / 5 + 0.0, 1)
    return rows.agg(
        F.count("*").alias("n"),
        F.abs(tenth(F.avg("z"))).alias("mean"),
        tenth(F.stddev("z")).alias("deviation"),
        F.round(F.avg("u") - 2, 1).alias("half"),
        tenth(F.avg("g")).alias("gamma"),
        F.count_if((F.col("u") < 2) | (F.col("u") >= 3) | (F.col("g") <= 0)).alias("outside"),
    )
