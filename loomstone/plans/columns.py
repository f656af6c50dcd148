"""Further queries over columns: arrays, maps, text, codes, dates and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions import codec as K
from loomstone.functions import collections as C
from loomstone.functions import nested as J
from loomstone.functions import numeric as N
from loomstone.functions import stats as S
from loomstone.functions import temporal as D
from loomstone.functions import text as X
from loomstone.plans.registry import Registry, dealt, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
_WORDS = """w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
            i AS (SELECT *, len(w) AS n, list_filter(range(1, len(w) + 1), lambda i: w[i] > 'm')[1] AS i FROM w)"""


def _joined(a):
    return F.array_join(a, "-")


@_R.add(
    "q_array_cuts",
    f"""
    WITH {_WORDS}
    SELECT p_partkey, array_to_string(w[1:2], '-') AS lead, array_to_string(w[3:], '-') AS rest, array_to_string(w[3:], '-') AS since,
           array_to_string(w[1:coalesce(i, n) - 1], '-') AS before, array_to_string(w[1:coalesce(i, n)], '-') AS upto,
           CASE WHEN i IS NOT NULL THEN array_to_string(w[1:i - 1], '-') || '|' || array_to_string(w[i:], '-') END AS parted FROM i
    """,
)
def array_cuts(spark, sf_dir):
    """Arrays parted at places and at the first match."""
    w, late = F.split("p_name", " "), lambda x: x > "m"
    both, parted = C.snip(w, 2), C.snip_match(w, late)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        _joined(both["left"]).alias("lead"),
        _joined(both["right"]).alias("rest"),
        _joined(C.from_(w, 2)).alias("since"),
        _joined(C.before_match(w, late)).alias("before"),
        _joined(C.upto_match(w, late)).alias("upto"),
        F.concat(_joined(parted["left"]), F.lit("|"), _joined(parted["right"])).alias("parted"),
    )


@_R.add(
    "q_array_sifts",
    f"""
    WITH {_WORDS}, f AS (SELECT *, list_filter(w, lambda x: x > 'm') AS yes, list_filter(w, lambda x: x <= 'm') AS no FROM i)
    SELECT p_partkey, len(no) = 0 AS every, array_to_string(yes, '-') AS yes, array_to_string(no, '-') AS no,
           CASE WHEN len(yes) = 1 THEN yes[1] END AS only, CASE WHEN len(yes) > 0 THEN len(yes) END AS some,
           array_to_string(list_transform(yes, lambda x: upper(x)), '-') AS swept,
           array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 2 THEN 'X' ELSE x END), '-') AS defined,
           array_to_string(list_concat(list_reverse(w), ['z']), '-') AS wound,
           array_to_string(list_transform(list_sort(list_transform(w, lambda x, i: {{'k': length(x), 'i': i, 'x': x}})), lambda s: s.x), '-') AS by_length,
           array_to_string(map_keys(map_from_entries(list_transform(list_distinct(list_transform(w, lambda x: length(x))), lambda k: {{'k': k, 'v': 1}}))), '') <> '' AS keyed,
           list_filter(w, lambda x: length(x) = length(w[1]))[-1] AS last_of_length FROM f
    """,
)
def array_sifts(spark, sf_dir):
    """Arrays divided, swept, redefined, sorted and indexed."""
    w, late = F.split("p_name", " "), lambda x: x > "m"
    some, parts = F.filter(w, late), C.partition(w, late)
    index = C.index_by(w, F.length)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        C.all_(w, late).alias("every"),
        _joined(parts["yes"]).alias("yes"),
        _joined(parts["no"]).alias("no"),
        C.unique(some).alias("only"),
        F.nullif(F.size(F.coalesce(C.occupied(some), F.array().cast("array<string>"))).cast("long"), F.lit(0).cast("long")).alias("some"),
        _joined(C.sweep(w, late, F.upper)).alias("swept"),
        _joined(C.define(w, 1, F.lit("X"))).alias("defined"),
        _joined(C.unwind(w, F.array(F.lit("z")))).alias("wound"),
        _joined(C.sort_by(w, F.length)).alias("by_length"),
        (F.size(index) > 0).alias("keyed"),
        F.try_element_at(index, F.length(F.get(w, F.lit(0)))).alias("last_of_length"),
    )


@_R.add(
    "q_array_algebra",
    """
    WITH k AS (SELECT p_partkey AS k, p_partkey % 24 AS r FROM part),
         a AS (SELECT *, r // 6 AS a, list_filter([0, 1, 2, 3], lambda x: x <> r // 6) AS l FROM k),
         b AS (SELECT *, l[r % 6 // 2 + 1] AS b FROM a), c AS (SELECT *, list_filter(l, lambda x: x <> b) AS m FROM b),
         p AS (SELECT *, [a, b, m[r % 2 + 1], m[2 - r % 2]] AS p FROM c)
    SELECT k AS p_partkey, k % 12 <= 8 AS run, '1,2,0,' || k AS laid, CASE WHEN k % 3 <> 0 THEN k || ',1' END AS whole,
           CASE WHEN k % 2 = 1 THEN k + 1 END AS moved, array_to_string(p, ',') AS permutation, r::BIGINT AS rank,
           array_to_string(list_transform(p, lambda x: ['a', 'b', 'c', 'd'][x + 1]), '') AS permuted, 0 AS removed, k || ',1,2' AS plus, k::VARCHAR AS fresh FROM p
    """,
)
def array_algebra(spark, sf_dir):
    """Runs, separators, all-or-nothing arrays, permutations, and maps of arrays."""
    k = F.col("p_partkey")
    order = C.permutation(k % 24, 4)
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    held = F.create_map(F.lit("a"), F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    numbers = C.traverse(F.array(F.when(k % 2 == 1, k.cast("string")).otherwise("x")), lambda x: x.try_cast("bigint") + 1)
    return dealt(table(spark, sf_dir, "part").select("p_partkey")).select(
        "p_partkey",
        C.subsumes(F.sequence(F.lit(0), F.lit(9)), F.array((k % 12).cast("int"), (k % 12 + 1).cast("int"))).alias("run"),
        text(C.intercalate(F.array(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), F.array(k.cast("bigint"))), F.array(F.lit(0).cast("bigint")))).alias("laid"),
        text(C.sequence_all(F.array(F.when(k % 3 != 0, k.cast("bigint")), F.lit(1).cast("bigint")))).alias("whole"),
        F.get(numbers, F.lit(0)).alias("moved"),
        text(order).alias("permutation"),
        C.permutation_rank(order).alias("rank"),
        F.array_join(C.permute(F.array(*map(F.lit, "abcd")), order), "").alias("permuted"),
        F.size(C.removed(held, F.lit("a"))).alias("removed"),
        text(F.element_at(C.plus(held, F.lit("a"), k.cast("bigint")), F.lit("a"))).alias("plus"),
        text(F.element_at(C.plus(held, F.lit("b"), k.cast("bigint")), F.lit("b"))).alias("fresh"),
    )


@_R.add(
    "q_text_shapes",
    r"""
    WITH t AS (SELECT p_partkey, replace(p_name, ' ', '-') AS k, replace(p_name, ' ', '_') AS s, p_name AS n, p_brand AS b FROM part)
    SELECT p_partkey, array_to_string(string_split(k, '-'), '+') AS kebab, array_to_string(string_split(s, '_'), '+') AS snake,
           array_to_string(list_transform(range(0, length(n), 4), lambda i: substr(n, i + 1, 4)), '|') AS slices, length(n) AS chars,
           left(n, 2) || '.' || substr(n, 4) AS punched, length(n) - length(replace(n, 'e', '')) AS es, false AS blank,
           CASE WHEN length(n) >= 40 THEN n ELSE repeat('*', (40 - length(n)) // 2) || n || repeat('*', 40 - length(n) - (40 - length(n)) // 2) END AS centered,
           translate(n, 'ae', '') AS erased, translate(n, 'abc', 'xyz') AS mapped, replace(n, ' ', chr(160)) AS ossified,
           translate(p_partkey::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS low, translate(p_partkey::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS high,
           regexp_replace(n, '[aeiou]', '*') AS one, regexp_replace(n, '[aeiou]', '*', 'g') AS every, regexp_replace(b, '([a-z])(#)', '\1|\2', 'g') AS broken,
           regexp_full_match(n, '[a-z ]+') AS matched, strpos(n, 'e') - 1 AS at, true AS smart, false AS not_smart, 3 AS lines FROM t
    """,
)
def text_shapes(spark, sf_dir):
    """Texts taken apart, counted, filled, mapped, marked and matched."""
    n, key = F.col("p_name"), F.col("p_partkey").cast("string")
    punched = X.punch(n, 2)
    plus = lambda a: F.array_join(a, "+")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        plus(X.unkebab(F.replace(n, F.lit(" "), F.lit("-")))).alias("kebab"),
        plus(X.unsnake(F.replace(n, F.lit(" "), F.lit("_")))).alias("snake"),
        F.array_join(X.slices(n, 4), "|").alias("slices"),
        F.size(X.chars(n)).cast("long").alias("chars"),
        F.concat(punched["left"], F.lit("."), punched["right"]).alias("punched"),
        X.count_chars(n, lambda c: c == "e").cast("long").alias("es"),
        X.blank(n).alias("blank"),
        X.center(n, 40, "*").alias("centered"),
        X.erase(n, "ae").alias("erased"),
        X.tr(n, "abc", "xyz").alias("mapped"),
        X.ossify(n).alias("ossified"),
        X.subscripts(key).alias("low"),
        X.superscripts(key).alias("high"),
        X.sub_pattern(n, "[aeiou]", "*", 1).alias("one"),
        X.sub_pattern(n, "[aeiou]", "*").alias("every"),
        X.broken(F.col("p_brand"), "[a-z]", "#", "|").alias("broken"),
        X.matches(n, "[a-z ]+").alias("matched"),
        F.coalesce(X.seek_span(n, "e")["start"], F.lit(-1)).cast("long").alias("at"),
        X.smart_case_equal(n, F.upper(n)).alias("smart"),
        X.smart_case_equal(F.upper(n), n).alias("not_smart"),
        F.size(X.delineate(F.concat(n, F.lit("\r\nx\r"), n))).alias("lines"),
    )


@_R.add(
    "q_text_names",
    """
    WITH c AS (SELECT unnest(['almond', 'blush', 'cream', 'lemon', 'steel']) AS c, unnest(range(5)) AS i),
         w AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS w FROM part),
         r AS (SELECT p_partkey, c, row_number() OVER (PARTITION BY p_partkey ORDER BY levenshtein(w, c), i) AS n FROM w, c)
    SELECT p_partkey, c AS closest, 'GREEK SMALL LETTER ALPHA' AS letter, 'xn--bcher-kva.example' AS host FROM r WHERE n = 1
    """,
)
def text_names(spark, sf_dir):
    """The closest of some words, names of characters, and host names in ASCII."""
    first = F.get(F.split("p_name", " "), F.lit(0))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.closest(first, ["almond", "blush", "cream", "lemon", "steel"]).alias("closest"),
        X.character_name(F.concat(F.lit("α"), first)).alias("letter"),
        X.punycode(F.concat(F.lit("bücher.example"), F.left(first, F.lit(0)))).alias("host"),
    )


@_R.add(
    "q_codes",
    """
    WITH t AS (SELECT p_partkey AS k, p_name AS n, md5(p_name) AS m, p_partkey % 2 = 0 AS good FROM part)
    SELECT k AS p_partkey, sha256('{"c0":"' || n || '","c1":null}') AS row_digest, n AS from_hex, NULL::VARCHAR AS no_hex, lpad(bin(k % 256), 8, '0') AS bits,
           (strlen(n) + 4) // 5 * 8 AS base32, n AS back, good AS isin, CASE WHEN good THEN 'US' END AS country, CASE WHEN good THEN '037833100' END AS nsin,
           '302817' AS letters, left(m, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS uuid,
           k::BIGINT AS minor, 'rc.1' AS prerelease, true AS earlier, (k % 90 + 0.5)::DOUBLE AS latitude, 'é' AS latin, NULL::VARCHAR AS skipped, n AS packed, NULL::VARCHAR AS no_pack FROM t
    """,
)
def codes(spark, sf_dir):
    """Digests of rows, number texts, identifiers, versions, places, charsets and compression."""
    k, n = F.col("p_partkey"), F.col("p_name")
    raw = n.cast("binary")
    isin = F.when(k % 2 == 0, F.lit("US0378331005")).otherwise("US0378331006")
    version = F.concat(F.lit("1."), k.cast("string"), F.lit(".0-rc.1+b"))
    release = F.concat(F.lit("1."), k.cast("string"), F.lit(".0"))
    packed = raw
    for name in ("gzip", "zlib", "deflate", "bzip2", "xz"):
        packed = K.decompress(K.compress(packed, name), name)
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(
        "p_partkey",
        K.digest_row(n, F.lit(None).cast("string")).alias("row_digest"),
        K.from_hex(F.hex(raw)).cast("string").alias("from_hex"),
        K.from_hex(F.concat(F.lit("zz"), n)).cast("string").alias("no_hex"),
        K.to_base2(F.unhex(F.lpad(F.hex(k % 256), 2, "0"))).alias("bits"),
        F.length(K.to_base32(raw)).cast("long").alias("base32"),
        K.from_base32(K.to_base32(raw)).cast("string").alias("back"),
        K.isin_valid(isin).alias("isin"),
        K.isin_country(isin).alias("country"),
        K.isin_nsin(isin).alias("nsin"),
        K.isin_digits(F.concat(F.lit("US"), F.lit("17").substr(F.lit(1), F.lit(2)), F.left(n, F.lit(0)))).alias("letters"),
        K.uuid(F.concat(F.lit("{"), F.upper(F.md5(raw)), F.lit("}"))).alias("uuid"),
        K.semver(version)["minor"].alias("minor"),
        K.semver(version)["prerelease"].alias("prerelease"),
        (K.semver_key(version) < K.semver_key(release)).alias("earlier"),
        K.geo_uri(F.concat(F.lit("geo:"), (k % 90).cast("string"), F.lit(".5,10")))["latitude"].alias("latitude"),
        K.decoded(F.unhex(F.concat(F.lit("E9"), F.left(n, F.lit(0)))), "ISO-8859-1").alias("latin"),
        K.decoded(F.unhex(F.concat(F.lit("FF"), F.left(n, F.lit(0)))), malformed="skip").alias("skipped"),
        packed.cast("string").alias("packed"),
        K.decompress(raw, "gzip").cast("string").alias("no_pack"),
    )


_DAYS = "(SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"


@_R.add(
    "q_dates_named",
    f"""
    SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS back, year(d) || '/' || dayofyear(d) AS ordinal, year(d) || '/' || month(d) || '/' || day(d) AS papal,
           year(d) || '/' || month(d) || '/' || day(d) AS british, month(d) || '/' || day(d) AS anniversary,
           strftime(CASE WHEN month(d) = 2 AND day(d) = 29 THEN DATE '2023-02-28' ELSE make_date(2023, month(d), day(d)) END, '%Y-%m-%d') AS down,
           strftime(CASE WHEN month(d) = 2 AND day(d) = 29 THEN DATE '2023-03-01' ELSE make_date(2023, month(d), day(d)) END, '%Y-%m-%d') AS up,
           strftime(d + INTERVAL 1 MONTH + INTERVAL 1 MONTH, '%Y-%m-%d') AS drifted, strftime(d, '%B') AS month, strftime(d, '%A') AS weekday,
           strftime(d + INTERVAL 14 DAY, '%Y-%m-%d') AS third, 3 AS united, epoch_us(d::TIMESTAMP - INTERVAL 2 HOUR) AS instant, 5 AS parsed, true AS tai,
           25 AS hours, 6 AS months FROM {_DAYS}
    """,
)
def dates_named(spark, sf_dir):
    """Dates of other calendars, anniversaries, recurrences, names, instants and spans."""
    d = F.col("d")
    path = lambda s, *names: F.concat_ws("/", *[s[n].cast("string") for n in names])
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    weekly = D.rule(d, until=F.date_add(d, 100), **D.rule_parts("RRULE:FREQ=WEEKLY;COUNT=3"))
    both = D.recurrent([F.array(d, F.date_add(d, 7)), F.array(d)], extra=["1900-01-01", "1900-01-02"], without=["1900-01-02"])
    noon = d.cast("timestamp")
    iso_week = F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"), F.lit("-"), (F.weekday(d) + 1).cast("string"))
    forms = [
        text(d),
        F.date_format(d, "yyyyMMdd"),
        iso_week,
        F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(F.dayofyear(d).cast("string"), 3, "0")),
        F.date_format(d, "EEE, d MMM yyyy HH:mm:ss 'GMT'"),
    ]
    half = D.parse_span(F.lit("P3MT12H30M"))
    twice = D.add_spans(D.scale_span(half, 3), half, -1)
    return (
        dealt(table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")))
        .select(
            "o_orderkey",
            text(D.from_jdn(D.jdn(d))).alias("back"),
            path(D.ordinal(d), "year", "day").alias("ordinal"),
            path(D.papal(d), "year", "month", "day").alias("papal"),
            path(D.british(d), "year", "month", "day").alias("british"),
            path(D.anniversary(d), "month", "day").alias("anniversary"),
            text(D.anniversary_in(d, F.lit(2023))).alias("down"),
            text(D.anniversary_in(d, F.lit(2023), True)).alias("up"),
            text(F.element_at(D.recur(d, 1, "months", 3), 3)).alias("drifted"),
            D.month_name(d).alias("month"),
            D.weekday_name(d).alias("weekday"),
            text(F.element_at(weekly, 3)).alias("third"),
            F.size(both).alias("united"),
            F.unix_micros(D.to_instant(noon, "+02:00")).alias("instant"),
            sum((F.to_date(D.parse_instant(s)) == d).cast("int") for s in forms).alias("parsed"),
            (D.from_tai(D.to_tai(noon)) == noon).alias("tai"),
            (twice["hours"] + (twice["minutes"] / 60).cast("int")).cast("int").alias("hours"),
            twice["months"].cast("int").alias("months"),
        )
    )


@_R.add(
    "q_number_edges",
    """
    WITH k AS (SELECT c_custkey AS k, c_acctbal AS x FROM customer)
    SELECT k AS c_custkey, floor(-k / 4.0)::BIGINT AS floored, (8 * k)::DOUBLE AS scaled, pow(2.0, k % 20 - 52) AS ulp, pow(2.0, k % 20 - 52) AS up, pow(2.0, k % 20 - 53) AS down,
           (k % 20)::INT AS exponent, k % 3 <> 0 AS finite, (3 + 2 * k) // gcd(3 + 2 * k, 6) || '/' || 6 // gcd(3 + 2 * k, 6) AS total, k // gcd(k, 6) || '/' || 6 // gcd(k, 6) AS product,
           round((k + 459.67) * 5 / 9, 6)::DOUBLE AS kelvin, CASE WHEN abs(x) >= 1000 THEN 'k' WHEN abs(x) >= 1 THEN '' WHEN abs(x) >= 0.001 THEN 'm' ELSE 'n' END AS prefix,
           round(k + pi() - 2 * pi() * floor((k + pi()) / (2 * pi())) - pi(), 6) AS angle, '0.0/' || round(1 - (k % 4) / 4.0, 2)::DOUBLE || '/1.0' AS hsv,
           CASE WHEN k = 0 THEN 0.0 ELSE round(round_even(k * 1.2345::DOUBLE / pow(10.0, floor(log10(k * 1.2345::DOUBLE)) - 2), 0) * pow(10.0, floor(log10(k * 1.2345::DOUBLE)) - 2), 6) END AS figures FROM k
    """,
)
def number_edges(spark, sf_dir):
    """Parts of floating-point numbers, rationals, temperatures, prefixes, angles, colours and significant figures."""
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    two = F.pow(F.lit(2.0), (k % 20).cast("double"))
    shown = lambda r: F.concat_ws("/", r["num"].cast("string"), r["den"].cast("string"))
    one = lambda a, b: N.rational(F.lit(a).cast("bigint") if isinstance(a, int) else a, F.lit(b).cast("bigint"))
    colour = N.hsv(F.lit(1.0), (k % 4) / 4.0, (k % 4) / 4.0)
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).select(
        "c_custkey",
        N.floor_div(-k, F.lit(4)).alias("floored"),
        N.scalb(k.cast("double"), 3).alias("scaled"),
        N.ulp(two).alias("ulp"),
        (N.next_up(two) - two).alias("up"),
        (two - N.next_down(two)).alias("down"),
        N.exponent(two).alias("exponent"),
        N.finite(F.when(k % 3 == 0, F.lit(float("inf"))).otherwise(k.cast("double"))).alias("finite"),
        shown(N.add_rationals(one(1, 2), one(k, 3))).alias("total"),
        shown(N.multiply_rationals(one(2, 3), one(k, 4))).alias("product"),
        F.round(N.fahrenheit_to_kelvin(k), 6).alias("kelvin"),
        N.metric_prefix(x).alias("prefix"),
        F.round(N.canonical(k.cast("double")), 6).alias("angle"),
        F.concat_ws("/", colour["hue"].cast("string"), F.round(colour["saturation"], 2).cast("string"), colour["value"].cast("string")).alias("hsv"),
        F.round(N.decimalize(k * F.lit(1.2345), 3), 6).alias("figures"),
    )


@_R.add(
    "q_linear_algebra",
    """
    WITH k AS (SELECT c_custkey AS c, (c_custkey % 50 + 1)::DOUBLE AS k FROM customer)
    SELECT c AS c_custkey, [2.0, 3 * k - 1, -2 * k] AS crossed, [k, 1.0] AS same, 2.0::DOUBLE AS doubled, [4.0, 6.0, 7.0, k] AS minor, round(42 - 4 * k, 6) AS cofactor,
           [3.0, -1.0, -2.0, k] AS adjugate, [4.0, -2.0, -2.0, 1.0]::DOUBLE[] AS singular, [round(k / 2, 6), 0.25] AS solved, [2.0, k + 2] AS eigenvalues,
           [1.0, 0.0, round(1 / sqrt(1 + k * k), 6), round(k / sqrt(1 + k * k), 6)] AS eigenvectors,
           5 * k AS modulus, round(pi() / 4, 6) AS argument, round(sqrt(k), 6) AS root, 0.0::DOUBLE AS re, k * k + 1 AS im FROM k
    """,
)
def linear_algebra(spark, sf_dir):
    """Vectors, small matrices with their eigenvectors, and complex numbers."""
    k = (F.col("c_custkey") % 50 + 1).cast("double")
    v = lambda *xs: F.array(*[(F.lit(float(x)) if isinstance(x, (int, float)) else x) for x in xs])
    rounded = lambda a: F.transform(a, lambda x: F.round(x, 6) + F.lit(0.0))
    z = lambda re, im: F.struct((F.lit(0.0) + re).alias("re"), (F.lit(0.0) + im).alias("im"))
    three, two = F.array(v(1, 2, 3), v(4, 5, 6), v(7, 8, k)), F.array(v(2, 1), v(0, k + 2))
    product = N.multiply_complex(z(k, 1.0), z(F.lit(1.0), k))
    return dealt(table(spark, sf_dir, "customer").select("c_custkey")).select(
        "c_custkey",
        N.cross(v(1, 2, 3), v(k, 0, 1)).alias("crossed"),
        N.matrix_apply(N.identity(2), v(k, 1)).alias("same"),
        F.get(F.get(N.matrix_add(N.identity(2), N.identity(2)), F.lit(0)), F.lit(0)).alias("doubled"),
        F.flatten(N.submatrix(three, 0, 1)).alias("minor"),
        F.round(N.cofactor(three, 0, 1), 6).alias("cofactor"),
        rounded(F.flatten(N.adjugate(F.array(v(k, 1), v(2, 3))))).alias("adjugate"),
        rounded(F.flatten(N.adjugate(F.array(v(1, 2), v(2, 4))))).alias("singular"),
        rounded(N.solve(N.inverse(F.array(v(2, 0), v(0, 4))), v(k, 1))).alias("solved"),
        rounded(N.eigenvalues(two)).alias("eigenvalues"),
        rounded(F.flatten(N.eigenvectors(two))).alias("eigenvectors"),
        N.modulus(z(3 * k, 4 * k)).alias("modulus"),
        F.round(N.argument(z(k, k)), 6).alias("argument"),
        F.round(N.complex_sqrt(z(0.0, 2 * k))["im"], 6).alias("root"),
        (product["re"] + 0.0).alias("re"),
        product["im"].alias("im"),
    )


@_R.add(
    "q_group_ends",
    """
    SELECT c_nationkey, min_by(c_name, c_custkey) AS first, max_by(c_name, c_custkey) AS last,
           (sum(c_custkey * 1000000)::HUGEINT // count(*))::BIGINT AS mean FROM customer GROUP BY 1
    """,
)
def group_ends(spark, sf_dir):
    """The first and the last of a group in an order, and a mean of instants."""
    when = F.timestamp_seconds("c_custkey")
    ends = [S.first_in(F.col("c_name"), F.col("c_custkey")).alias("first"), S.last_in(F.col("c_name"), F.col("c_custkey")).alias("last")]
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(*ends, F.unix_micros(S.mean_instant(when)).alias("mean"))


@_R.add(
    "q_record_shapes",
    """
    WITH k AS (SELECT c_custkey AS k, c_name AS n FROM customer)
    SELECT k AS c_custkey, k % 2 = 0 AS circle, CASE WHEN k % 2 = 0 THEN k::DOUBLE END AS radius, CASE WHEN k % 2 = 1 THEN n END AS label, 'a=1,c=' || k AS patched,
           n AS pretty, true AS same_schema, k::BIGINT AS address_code, n AS name, coalesce(nullif(k % 2, 0), 7)::BIGINT AS or_seven, CASE WHEN k % 2 = 0 THEN 'none' ELSE 'x' || k END AS laid FROM k
    """,
)
def record_shapes(spark, sf_dir):
    """Tagged unions, patches of maps, JSON Schemas, flat records and defaults."""
    k, n = F.col("c_custkey"), F.col("c_name")
    text = F.when(k % 2 == 0, F.format_string('{"kind": "circle", "radius": %d}', k)).otherwise(F.format_string('{"kind": "note", "label": "%s"}', n))
    shape = J.by_kind(text, {"circle": "radius double", "note": "label string"})
    maybe = F.when(k % 2 == 1, k)
    patched = J.merge_patch(
        F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("c"), k.cast("string"))
    )
    entries = F.array_sort(F.transform(F.map_entries(patched), lambda e: F.concat_ws("=", e["key"], e["value"])))
    record = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("address", T.StructType([T.StructField("code", T.LongType())]))])
    same = J.from_json_schema(J.to_json_schema(record)) == record
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", n.alias("name"), F.struct(k.cast("bigint").alias("code")).alias("address"))
    return rows.select(
        "c_custkey",
        shape["circle"].isNotNull().alias("circle"),
        shape["circle"]["radius"].alias("radius"),
        shape["note"]["label"].alias("label"),
        F.array_join(entries, ",").alias("patched"),
        F.get_json_object(J.pretty(F.struct(n.alias("n"))), "$.n").alias("pretty"),
        F.lit(same).alias("same_schema"),
        *J.flatten_record(record),
        J.or_(F.nullif(k % 2, F.lit(0)), 7).cast("bigint").alias("or_seven"),
        J.lay(maybe, F.lit("none"), lambda c: F.concat(F.lit("x"), c.cast("string"))).alias("laid"),
    )


@_R.add(
    "q_justify",
    """
    WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w, greatest(60 - length(p_name), 0) AS x FROM part)
    SELECT p_partkey, CASE WHEN len(w) = 1 THEN w[1] ELSE array_to_string(list_transform(w, lambda v, i:
           CASE WHEN i = 1 THEN v ELSE repeat(' ', (1 + x // (len(w) - 1) + CASE WHEN i - 1 <= x % (len(w) - 1) THEN 1 ELSE 0 END)::INT) || v END), '') END AS line FROM t
    """,
)
def justify(spark, sf_dir):
    """Names as lines of sixty characters."""
    return table(spark, sf_dir, "part").select("p_partkey", X.justify(F.col("p_name"), 60).alias("line"))


@_R.add(
    "q_clock",
    """
    WITH k AS (SELECT c_custkey AS k FROM customer)
    SELECT k AS c_custkey, k % 24 AS hour, k % 60 AS minute, k * 7 % 60 AS second, k % 1000 * 1000000 AS nanos,
           CASE WHEN k % 48 < 12 THEN 33::DOUBLE WHEN k % 48 >= 36 THEN 34::DOUBLE ELSE round(33 + (k % 48 - 12) / 24.0, 4)::DOUBLE END AS smeared FROM k
    """,
)
def clock(spark, sf_dir):
    """Times of day, and how far TAI is ahead around a leap second that is spread over a day."""
    k = F.col("c_custkey")
    millis = ((k % 24) * 3600 + (k % 60) * 60 + (k * 7) % 60) * 1000 + k % 1000
    clock = D.time_of_day(F.timestamp_millis(millis))
    instant = F.timestamp_micros((F.unix_seconds(F.lit("2008-12-31").cast("timestamp")) + (k % 48) * 3600) * 1_000_000)
    ahead = (F.unix_micros(D.smear_tai(instant)) - F.unix_micros(instant)) / 1e6
    return table(spark, sf_dir, "customer").select("c_custkey", *[clock[n].alias(n) for n in ("hour", "minute", "second", "nanos")], F.round(ahead, 4).alias("smeared"))
