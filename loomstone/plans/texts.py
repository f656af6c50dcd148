"""Queries over text functions, digests and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import codec as K
from loomstone.functions import text as X
from loomstone.operators import sketch
from loomstone.plans.registry import Registry, dealt, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.add(
    "q_words",
    r"""
    SELECT doc_id, len(string_split(text, ' ')) AS n_words, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars,
           md5(array_to_string(list_reverse(string_split(text, ' ')), ' ')) AS turned FROM documents
    """,
)
def words(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(X.words(t)).cast("long").alias("n_words"),
        F.size(X.lines(t)).cast("long").alias("n_lines"),
        F.length(t).cast("long").alias("n_chars"),
        F.md5(X.spaced(F.reverse(X.words(t))).cast("binary")).alias("turned"),
    )


@_R.add(
    "q_case_forms",
    r"""
    WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part),
         c AS (SELECT p_partkey, w, array_to_string(list_transform(w, lambda x: upper(left(x, 1)) || substr(x, 2)), '') AS pascal FROM w)
    SELECT p_partkey, array_to_string(w, '_') AS snake, array_to_string(w, '-') AS kebab, pascal, lower(left(pascal, 1)) || substr(pascal, 2) AS camel,
           CASE len(w) WHEN 1 THEN w[1] ELSE array_to_string(w[1:len(w) - 1], ', ') || ' and ' || w[len(w)] END AS listed FROM c
    """,
)
def case_forms(spark, sf_dir):
    w = F.split(F.lower("p_name"), " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.snake(w).alias("snake"), X.kebab(w).alias("kebab"), X.pascal(w).alias("pascal"), X.camel(w).alias("camel"), X.join_and(w).alias("listed")
    )


@_R.add(
    "q_capitalize",
    """
    SELECT p_partkey, upper(left(p_type, 1)) || substr(p_type, 2) AS capital, lower(left(p_brand, 1)) || substr(p_brand, 2) AS small,
           reverse(p_name) AS turned, array_to_string(string_split(lower(regexp_replace(p_brand, '(.)([A-Z])', '\\1 \\2', 'g')), ' '), '+') AS parts FROM part
    """.replace("\\\\", "\\"),
)
def capitalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.capitalize(F.col("p_type")).alias("capital"),
        X.uncapitalize(F.col("p_brand")).alias("small"),
        F.reverse("p_name").alias("turned"),
        F.array_join(X.uncamel(F.col("p_brand")), "+").alias("parts"),
    )


@_R.add(
    "q_chomp",
    """
    SELECT doc_id, CASE WHEN text LIKE '%.' THEN left(text, length(text) - 1) ELSE text END AS chomped,
           CASE WHEN text LIKE 'The %' THEN substr(text, 5) ELSE text END AS headless, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS trimmed
    FROM documents
    """,
)
def chomp(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.chomp(t, ".").alias("chomped"), X.chomp(t, "The ", right=False).alias("headless"), X.trim(t).alias("trimmed")
    )


@_R.add(
    "q_count_sub",
    """
    SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n_the,
           CASE WHEN instr(text, 'th') > 0 THEN instr(text, 'th') - 1 END AS first_th, md5(replace(text, 'e', '3')) AS replaced,
           text LIKE '%tion%' AS has_tion FROM documents
    """,
)
def count_sub(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        X.count(t, "the").cast("long").alias("n_the"),
        X.offset_of(t, "th").cast("long").alias("first_th"),
        F.md5(X.sub(t, "e", "3").cast("binary")).alias("replaced"),
        t.contains("tion").alias("has_tion"),
    )


@_R.add(
    "q_pad",
    """
    SELECT p_partkey, CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE rpad(p_brand, 12, '.') END AS padded,
           CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE lpad(p_brand, 12, '.') END AS flush, left(rpad(p_type, 8, ' '), 8) AS fitted,
           repeat('*', (p_size % 5)::INT) AS stars, p_size || CASE WHEN p_size = 1 THEN ' unit' ELSE ' units' END AS counted FROM part
    """,
)
def pad(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.pad(F.col("p_brand"), 12, ".").alias("padded"),
        X.pad(F.col("p_brand"), 12, ".", right=True).alias("flush"),
        X.fit(F.col("p_type"), 8).alias("fitted"),
        F.repeat(F.lit("*"), (size % 5).cast("int")).alias("stars"),
        F.concat_ws(" ", size, X.pluralize(size, "unit", "units")).alias("counted"),
    )


_PAIRS = "FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def _pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a = part.select("p_partkey", F.col("p_name").alias("a"))
    b = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return a.join(b, "p_partkey")


@_R.add(
    "q_levenshtein",
    f"""
    SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::BIGINT AS distance,
           round(levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS share {_PAIRS}
    """,
)
def levenshtein(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select(
        "p_partkey", X.levenshtein(a, b).cast("long").alias("distance"), F.round(X.normalized_levenshtein(a, b), 6).alias("share")
    )


@_R.add("q_jaro")
def jaro(spark, sf_dir):
    """Jaro similarity with half transpositions, which DuckDB's function rounds down; tests hold it against a plain version."""
    return _pairs(spark, sf_dir).select("p_partkey", F.round(X.jaro(F.col("a"), F.col("b")), 6).alias("likeness"))


@_R.add("q_jaro_winkler")
def jaro_winkler(spark, sf_dir):
    """Raised for a common prefix whatever the Jaro similarity is."""
    return _pairs(spark, sf_dir).select("p_partkey", F.round(X.jaro_winkler(F.col("a"), F.col("b")), 6).alias("likeness"))


@_R.add(
    "q_fuzzy_search",
    """
    WITH t AS (SELECT DISTINCT w AS term FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part)),
         q AS (SELECT DISTINCT reverse(w) AS query FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) UNION SELECT DISTINCT substr(w, 2) || w[1] FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part)
              UNION SELECT DISTINCT substr(w, 2) FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part))
    SELECT query, term, levenshtein(query, term)::INT AS distance FROM q, t WHERE levenshtein(query, term) <= 1
    """,
)
def fuzzy_search(spark, sf_dir):
    """All terms within one edit of a query, by deletion neighbourhoods."""
    w = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    turned = F.concat(F.expr("substr(w, 2)"), F.left("w", F.lit(1)))
    queries = w.select(F.explode(F.array(F.reverse("w"), turned, F.expr("substr(w, 2)"))).alias("query"))
    return sketch.fuzzy_search(w.withColumnRenamed("w", "term"), queries, "term", "query", 1)


@_R.add(
    "q_regex",
    r"""
    SELECT page_id, regexp_extract(url, '^(\w+)://([^/]+)', 2) AS host, len(regexp_extract_all(html, '<[a-z0-9]+')) AS n_tags,
           regexp_matches(html, '(?i)<script') AS scripted, md5(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS bare FROM pages
    """,
)
def regex(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^(\w+)://([^/]+)", 2).alias("host"),
        F.size(X.search(html, "<[a-z0-9]+")).cast("long").alias("n_tags"),
        html.rlike("(?i)<script").alias("scripted"),
        F.md5(F.regexp_replace(html, "<[^>]*>", " ").cast("binary")).alias("bare"),
    )


@_R.add(
    "q_search_spans",
    r"""
    WITH m AS (SELECT page_id, string_split_regex(html, '<[a-z]+[0-9]?') AS p, regexp_extract_all(html, '<[a-z]+[0-9]?') AS o FROM pages),
         k AS (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM m)
    SELECT page_id, string_agg(s || '-' || (s + length(o[i])), ',' ORDER BY i) AS spans FROM (
        SELECT *, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(o[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM k)
    GROUP BY 1
    """,
)
def search_spans(spark, sf_dir):
    """Where a pattern's matches are."""
    found = X.search_spans(F.col("html"), "<[a-z]+[0-9]?")
    spans = F.array_join(F.transform(found, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return table(spark, sf_dir, "pages").filter(F.col("html").rlike("<[a-z]+[0-9]?")).select("page_id", spans.alias("spans"))


@_R.add("q_glob", "SELECT page_id, url GLOB 'http*' AS any_http, regexp_matches(url, '^https?://[^/]+/[^/]*$') AS shallow FROM pages")
def glob(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url.rlike(X.glob("http**")).alias("any_http"), (url.rlike(X.glob("http://*/*")) | url.rlike(X.glob("https://*/*"))).alias("shallow"))


@_R.add(
    "q_url",
    r"""SELECT page_id, regexp_extract(url, '^(\w+):', 1) AS protocol, regexp_extract(url, '^\w+://([^/?#:]+)', 1) AS host,
    nullif(regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1), '') AS path FROM pages""",
)
def url(spark, sf_dir):
    u = K.url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", u["protocol"].alias("protocol"), u["host"].alias("host"), F.nullif(u["path"], F.lit("")).alias("path"))


@_R.add(
    "q_digest",
    "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, lower(hex(encode(text))) AS hex FROM documents",
)
def digest(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", *[K.digest(t, a).alias(a) for a in ("md5", "sha1", "sha256")], K.to_hex(t.cast("binary")).alias("hex")
    )


@_R.add(
    "q_base64",
    "SELECT doc_id, base64(encode(text)) AS plain, rtrim(translate(base64(encode(text)), '+/', '-_'), '=') AS url_safe, text AS back FROM documents",
)
def base64(spark, sf_dir):
    text = F.col("text").cast("binary")
    safe = K.to_base64(text, url_safe=True)
    return table(spark, sf_dir, "documents").select(
        "doc_id", K.to_base64(text).alias("plain"), safe.alias("url_safe"), K.from_base64(safe).cast("string").alias("back")
    )


@_R.add("q_digest_prefix", "SELECT doc_id FROM documents WHERE sha256(text) LIKE '0%'")
def digest_prefix(spark, sf_dir):
    digests = table(spark, sf_dir, "documents").select("doc_id", K.digest(F.col("text")).alias("d"))
    return sketch.with_prefix(digests, "d", "0").select("doc_id")


@_R.add("q_luhn", "SELECT o_orderkey, (10 - list_sum(list_transform(list_reverse(string_split(o_orderkey::VARCHAR, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN (CASE WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END) ELSE c::INT END))::BIGINT % 10) % 10 AS digit, true AS valid FROM orders")
def luhn(spark, sf_dir):
    """Check digits, and that numbers with theirs pass."""
    s = F.col("o_orderkey").cast("string")
    d = K.luhn_digit(s)
    return table(spark, sf_dir, "orders").select("o_orderkey", d.cast("long").alias("digit"), K.luhn_valid(F.concat(s, d.cast("string"))).alias("valid"))


@_R.add("q_bloom")
def bloom(spark, sf_dir):
    """A filter of the ids of English documents, asked for all: no false negative; SQL has no such filter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    shape = sketch.Bloom(100_000, 0.01)
    made = sketch.build(docs.filter("lang = 'en'"), F.col("doc_id"), shape)
    return sketch.probe(docs, F.col("doc_id"), made, shape)


@_R.add("q_graphemes")
def graphemes(spark, sf_dir):
    """Perceived characters and terminal columns of each text; SQL has neither."""
    t = F.col("text")
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size(X.graphemes(t)).alias("n"), X.display_width(t).alias("width"))
