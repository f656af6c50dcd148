"""The registered queries of the training-data operators, each with SQL where SQL can state its result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.bitplanes import crc32, read_documents, write_ids
from loomstone.llm.bpe import encode
from loomstone.llm.common import documents
from loomstone.llm.decontaminate import contamination
from loomstone.llm.license_scan import scan_licenses
from loomstone.llm.line_dedup import dedup_lines
from loomstone.llm.merkle import fingerprint, likeness, with_next
from loomstone.llm.secret_scan import MORE_RULES, RULES, scan_secrets, update_ledger
from loomstone.llm.simhash import near_duplicates
from loomstone.llm.token_counts import count_tokens
from loomstone.llm.toxicity import score_toxicity
from loomstone.session import shared_path


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-ids")
    write_ids(documents(spark, sf_dir), path, word_vocabulary())
    return read_documents(spark, path, each=crc32).select("doc_id", "start", "n_tokens", F.col("digest").alias("ids_crc32"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "largest")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(documents(spark, sf_dir).select("doc_id", "text"), word_vocabulary(), decoded="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(listed, "utf-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
), k AS (
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM keyed
), f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    return (
        with_next(docs, "doc_id", "text", "next_text")
        .select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"))
        .select(
            "doc_id",
            "n_chars",
            F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
            fingerprint(F.col("text")).alias("fingerprint"),
            fingerprint(F.col("edited")).alias("edited_fingerprint"),
            fingerprint(F.col("next_text")).alias("next_fingerprint"),
        )
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        )
    )


def _print_sql(x: str) -> str:
    clauses = r"string_split(regexp_replace(p, '([.!?,;:|&$%*#][ \t]+)', '\1' || chr(1), 'g'), chr(1))"
    paragraph = f"md5(p) || '.' || array_to_string(list_transform({clauses}, lambda c: left(md5(c), 8)), '')"

    def over(children: str, sep: str, end: str) -> str:
        heads = "array_to_string(list_transform(l, lambda h: left(h, 32)), '')"
        return f"list_transform([{children}], lambda l: md5({heads}) || '{end}' || array_to_string(l, '{sep}'))[1]"

    section = over(f"list_transform(string_split(s, chr(10)), lambda p: {paragraph})", ",", "/")
    return over(f"list_transform(string_split({x}, chr(10) || chr(10)), lambda s: {section})", ";", ":")


def _marks_sql(p: str) -> str:
    each = f"regexp_replace(regexp_replace({p}, '^[0-9a-f]{{32}}:', ';'), '[;,](?:[0-9a-f]{{32}}/)?[0-9a-f]{{32}}\\.', '', 'g')"
    return f"list_distinct(regexp_extract_all({each}, '[0-9a-f]{{8}}'))"


def _likeness_sql(a: str, b: str) -> str:
    x, y = _marks_sql(a), _marks_sql(b)
    return (
        f"CASE WHEN left({a}, 32) = left({b}, 32) THEN 1.0::DOUBLE"
        f" ELSE len(list_intersect({x}, {y}))::DOUBLE / (greatest(len({x}), len({y})) + 1) END"
    )


OP7_SQL = f"""
WITH o AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nxt
    FROM documents WINDOW w AS (ORDER BY doc_id DESC)
), e AS (
    SELECT doc_id, t, nxt, length(t) AS n, substr(t, 1, length(t) - length(t) // 3) || substr(nxt, 1, length(t) // 3) AS ed FROM o
), p AS (
    SELECT doc_id, n, sha256(ed) AS edited_sha256, {_print_sql("t")} AS a, {_print_sql("ed")} AS b, {_print_sql("nxt")} AS c FROM e
)
SELECT doc_id, n AS n_chars, edited_sha256, a AS fingerprint, b AS edited_fingerprint, {_likeness_sql("a", "b")} AS near_edited,
       {_likeness_sql("a", "c")} AS near_next
FROM p
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("licenses.name", ",").alias("names"),
        F.coalesce(F.array_max("licenses.containment"), F.lit(0.0)).alias("containment"),
        "licenses",
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans over one ledger: the first fills it, the second finds no unseen pair of blob and rule and joins."""
    docs, ledger = documents(spark, sf_dir).select("doc_id", "text"), shared_path(spark, "secret-ledger")
    update_ledger(docs, ledger, RULES + MORE_RULES)
    found = scan_secrets(docs, RULES + MORE_RULES, ledger)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in RULES]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base_sha256 = F.sha2(F.encode(listed(base), "utf-8"), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base_sha256, listed(F.col("secrets")).alias("spans"))


def _matches_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
    SELECT doc_id, '{kind}' AS kind, {rank} AS rank, k,
           (SELECT coalesce(sum(length(x)), 0) FROM (SELECT unnest(pieces[1:k + 1]) AS x))
           + (SELECT coalesce(sum(length(x)), 0) FROM (SELECT unnest(own[1:k]) AS x)) AS start,
           length(own[k + 1]) AS len, length(judged[k + 1]) >= {least} AS good
    FROM (SELECT doc_id, string_split_regex(text, {p}) AS pieces, regexp_extract_all(text, {p}) AS own,
                 regexp_extract_all(text, {p}, {group}) AS judged,
                 unnest(range(len(regexp_extract_all(text, {p})))) AS k FROM d)"""


OP9_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ("
    + " UNION ALL ".join(
        [
            _matches_sql("assign", 0, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            _matches_sql("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
            _matches_sql("hex", 2, r"[0-9a-f]{24,}", 0, 24),
            _matches_sql("private_key", 3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
            _matches_sql("web_token", 4, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
            _matches_sql("code_host", 5, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
        ]
    )
    + """), s AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || (start + len), ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
             string_agg(kind || ':' || start || ':' || (start + len), ',' ORDER BY start, rank) AS spans FROM m WHERE good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)
"""
)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(items, "utf-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH dw AS (
    SELECT doc_id, w FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), bw AS (
    SELECT item_id, w FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), win AS (
    SELECT item_id, n, array_to_string(w[k + 1:k + n], ' ') AS win FROM (
        SELECT item_id, w, least(10, len(w)) AS n, unnest(range(greatest(len(w) - 9, 1))) AS k FROM bw)
), sizes AS (SELECT DISTINCT n FROM win), dwin AS (
    SELECT doc_id, k, n, array_to_string(w[k + 1:k + n], ' ') AS win FROM (
        SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS k FROM dw, sizes)
), hit AS (SELECT DISTINCT doc_id, k, d.n, item_id FROM dwin d JOIN win b ON d.win = b.win AND d.n = b.n),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_bitplanes,
        op2_token_counts,
        op3_bpe,
        op4_toxicity,
        op5_simhash,
        op6_line_dedup,
        op7_merkle,
        op8_license_scan,
        op9_secret_scan,
        op10_decontaminate,
    )
    return {q.__name__: q for q in each}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op7_merkle": OP7_SQL, "op9_secret_scan": OP9_SQL, "op10_decontaminate": OP10_SQL}
