"""Queries over numbers, vectors, money and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import numeric as N
from loomstone.operators import sketch
from loomstone.plans.registry import Registry, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.add(
    "q_number_forms",
    """
    SELECT p_partkey, lower(to_hex(p_partkey)) AS hex, bin(p_partkey) AS binary, gcd(p_partkey, p_size)::BIGINT AS gcd, lcm(p_partkey, p_size)::BIGINT AS lcm,
           (p_partkey - (-7) * floor(p_partkey / -7.0))::BIGINT AS floor_mod, floor(p_retailprice + 0.5)::BIGINT AS rounded FROM part
    """,
)
def number_forms(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        N.radix(k, 16).alias("hex"),
        F.bin(k).alias("binary"),
        N.gcd(k, s).alias("gcd"),
        N.lcm(k, s).cast("long").alias("lcm"),
        N.floor_mod(k, F.lit(-7)).cast("long").alias("floor_mod"),
        N.round_half_up(F.col("p_retailprice")).alias("rounded"),
    )


@_R.add(
    "q_rounding",
    """
    WITH t AS (SELECT p_partkey, (p_partkey % 9 - 4) / 4.0 AS x FROM part)
    SELECT p_partkey, ceil(abs(x)) * sign(x) + 0.0 AS up, floor(abs(x)) * sign(x) + 0.0 AS down, ceil(x) + 0.0 AS ceiling, floor(x) + 0.0 AS floor,
           floor(abs(x) + 0.5) * sign(x) + 0.0 AS half_up, ceil(abs(x) - 0.5) * sign(x) + 0.0 AS half_down, round_even(x, 0) + 0.0 AS half_even FROM t
    """,
)
def rounding(spark, sf_dir):
    """Seven ways to round quarters."""
    x = ((F.col("p_partkey") % 9) - 4) / 4.0
    modes = ("up", "down", "ceiling", "floor", "half_up", "half_down", "half_even")
    return table(spark, sf_dir, "part").select("p_partkey", *[(N.round_to(x, 0, m) + 0.0).cast("double").alias(m) for m in modes])


@_R.add("q_dot", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return v.join(after, "vec_id").select("vec_id", F.round(N.dot(F.col("embedding"), F.col("b")), 5).alias("dot"))


@_R.add(
    "q_norm",
    """
    SELECT vec_id, round(sqrt(list_dot_product(e, e)), 5) AS norm, true AS unit, round(list_sum(list_transform(e, lambda x: 2 * x)), 4) AS doubled
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    """,
)
def norm(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    doubled = F.aggregate(N.add(e, e), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(N.norm(e), 5).alias("norm"), (F.abs(N.norm(N.unitary(e)) - 1) < 1e-9).alias("unit"), F.round(doubled, 4).alias("doubled")
    )


@_R.add(
    "q_cosine_topk",
    """
    WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0),
         s AS (SELECT q, vec_id, round(list_cosine_similarity(a, embedding::DOUBLE[]), 6) AS c FROM q, embeddings WHERE vec_id <> q)
    SELECT q AS query, vec_id, c AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, vec_id) AS n FROM s) WHERE n <= 5
    """,
)
def cosine_topk(spark, sf_dir):
    """The five vectors nearest to each whose id is divisible by 50: a stated query set against all rows."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return sketch.nearest(v, v.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5).drop("rank")


@_R.add(
    "q_money_share",
    """
    WITH t AS (SELECT o_orderkey, (o_totalprice * 100)::BIGINT AS minor FROM orders)
    SELECT o_orderkey, minor // 3 + CASE WHEN minor % 3 > 0 THEN 1 ELSE 0 END AS first, minor // 3 AS last, minor AS total,
           minor + floor(minor * 0.2 + 0.5)::BIGINT AS with_tax FROM t
    """,
)
def money_share(spark, sf_dir):
    """Amounts in minor units shared three ways without loss, and with tax."""
    minor = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    parts = N.share(minor, 3)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.get(parts, F.lit(0)).alias("first"),
        F.get(parts, F.lit(2)).alias("last"),
        F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
        N.with_tax(minor, 0.2)["inclusive"].alias("with_tax"),
    )


_PLACES = "(SELECT c_custkey, (c_custkey * 37 % 160) - 80.0 AS lat, (c_custkey * 91 % 340) - 170.0 AS lon FROM customer)"


def _places(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", ((k * 37 % 160) - 80.0).alias("lat"), ((k * 91 % 340) - 170.0).alias("lon"))


@_R.add(
    "q_haversine",
    f"""
    SELECT c_custkey, round(2 * asin(sqrt(least(1, pow(sin((radians(51.5) - radians(lat)) / 2), 2)
           + cos(radians(lat)) * cos(radians(51.5)) * pow(sin(radians(0.0 - lon) / 2), 2)))), 6) AS angle,
           round(fmod(degrees(atan2(sin(radians(0.0 - lon)) * cos(radians(51.5)),
           cos(radians(lat)) * sin(radians(51.5)) - sin(radians(lat)) * cos(radians(51.5)) * cos(radians(0.0 - lon)))) + 360, 360), 4) AS bearing FROM {_PLACES}
    """,
)
def haversine(spark, sf_dir):
    """The angle and the bearing from each place to London."""
    lat, lon, there = F.col("lat"), F.col("lon"), (F.lit(51.5), F.lit(0.0))
    return _places(spark, sf_dir).select(
        "c_custkey", F.round(N.surface_angle(lat, lon, *there), 6).alias("angle"), F.round(N.bearing(lat, lon, *there), 4).alias("bearing")
    )


@_R.add("q_geohash")
def geohash(spark, sf_dir):
    """Geohashes and compass points; tests hold them against known places."""
    lat, lon = F.col("lat"), F.col("lon")
    return _places(spark, sf_dir).select("c_custkey", N.geohash(lat, lon, 8).alias("geohash"), N.compass(N.bearing(lat, lon, F.lit(0.0), F.lit(0.0)), 8).alias("towards"))


@_R.add(
    "q_matrix_rows",
    """
    WITH a AS (SELECT l_orderkey % 20 AS i, l_partkey % 15 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
         b AS (SELECT l_partkey % 15 AS i, l_suppkey % 10 AS j, sum(l_linenumber)::DOUBLE AS v FROM lineitem GROUP BY 1, 2)
    SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2
    """,
)
def matrix_rows(spark, sf_dir):
    """The product of two matrices given as rows."""
    line = table(spark, sf_dir, "lineitem")
    cell = lambda i, j, v: line.groupBy((F.col(i[0]) % i[1]).alias("i"), (F.col(j[0]) % j[1]).alias("j")).agg(F.sum(v).cast("double").alias("v"))
    a, b = cell(("l_orderkey", 20), ("l_partkey", 15), "l_quantity"), cell(("l_partkey", 15), ("l_suppkey", 10), "l_linenumber")
    return N.matrix_product_rows(a, b)


@_R.add("q_matrices")
def matrices(spark, sf_dir):
    """Small matrices as arrays of rows: products, determinants, inverses and eigenvalues."""
    m = F.array(*[F.array(*[F.get("e", F.lit(3 * i + j)) for j in range(3)]) for i in range(3)])
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", m.alias("m"))
    v = v.withColumn("inverse", N.inverse(F.col("m")))
    product = N.matrix_multiply(F.col("m"), F.col("inverse"))
    return v.select(
        "vec_id",
        F.round(N.determinant(F.col("m")), 6).alias("determinant"),
        N.rank(F.col("m")).alias("rank"),
        F.round(N.matrix_trace(product), 6).alias("identity_trace"),
        F.round(N.frobenius(N.transpose(F.col("m"))), 6).alias("frobenius"),
    )


@_R.add(
    "q_erf",
    "SELECT p_partkey, true AS close FROM part",
)
def erf(spark, sf_dir):
    """The error function is odd and lies within its bounds."""
    x = (F.col("p_partkey") % 60 - 30) / 10
    ok = (F.abs(N.erf(x)) <= 1) & (F.abs(N.erf(x) + N.erf(-x)) < 1e-12)
    return table(spark, sf_dir, "part").select("p_partkey", ok.alias("close"))


@_R.add("q_units", "SELECT s_suppkey, round(s_acctbal * 1609.344 / 1000, 6) AS km, round(s_acctbal + 273.15, 6) AS kelvin FROM supplier")
def units(spark, sf_dir):
    x = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.round(N.convert(x, "mile", "kilometre"), 6).alias("km"), F.round(N.celsius_to_kelvin(x), 6).alias("kelvin")
    )
