"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger, two tables in a shared folder, holds which rules
at which version have seen a blob, and what they found. A scan reads one copy of each blob that some rule has yet
to see, adds to the ledger, and joins the findings to every row that has the blob.

Places are found with built-in functions: the pieces between matches and the matches themselves are measured, and
a running sum of their lengths gives each start in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.common import fresh, quoted
from loomstone.session import cut, shared_path


@dataclass(frozen=True)
class Rule:
    """``kind``: name; ``pattern``: what is matched, leftmost and without overlaps; ``group`` must have ``least``
    characters, or the match is dropped; ``hint``: a cheaper pattern that every text with a match has."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    # Runs of the class are maximal, so that a run of 24 or more is the same match with either bound.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)

#: What the base kinds do not state: key files, signed web tokens and access tokens with a known head.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ[A-Za-z0-9_-]+\."),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
)

FINDING = "array<struct<start:int,rank:int,kind:string,end:int,rule:string>>"


def _lengths(text: Column, rule: Rule) -> Column:
    """For each match in order: the lengths of the piece before it, of itself and of its judged group."""
    pieces = F.split(text, rule.pattern, -1)
    whole, judged = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    sizes = [F.transform(a, F.length) for a in (pieces, whole, judged)]
    zipped = F.arrays_zip(*[s.alias(n) for s, n in zip(sizes, ("before", "own", "judged"), strict=True)])
    kept = F.filter(zipped, lambda x: x["own"].isNotNull())
    return F.when(text.rlike(rule.hint), kept)


def find_spans(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of rows (blob, text, todo): what the rules named in ``todo`` find, start and end in code points.

    Rows that repeat a blob count once.
    """
    each = F.array(
        *[
            F.struct(
                F.lit(rank).alias("rank"),
                F.when(F.array_contains("todo", r.key), _lengths(F.col("text"), r)).alias("found"),
            )
            for rank, r in enumerate(rules)
        ]
    )
    w = Window.partitionBy("blob", "rank").orderBy("k")
    named = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rank") + 1)
    return (
        texts.select("blob", F.explode(each).alias("x"))
        .select("blob", "x.rank", F.posexplode("x.found").alias("k", "m"))
        .dropDuplicates(["blob", "rank", "k"])
        .withColumn("start", F.sum("m.before").over(w) + F.sum("m.own").over(w) - F.col("m.own"))
        .filter(F.col("m.judged") >= named([r.least for r in rules]))
        .select(
            "blob",
            F.struct(
                F.col("start").cast("int").alias("start"),
                "rank",
                named([r.kind for r in rules]).alias("kind"),
                (F.col("start") + F.col("m.own")).cast("int").alias("end"),
                named([r.key for r in rules]).alias("rule"),
            ).alias("span"),
        )
        .groupBy("blob")
        .agg(F.sort_array(F.collect_set("span")).alias("spans"))
    )


def _address(text: str) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(quoted(text).cast("string"), F.lit("")), "utf-8"), 256))


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> None:
    """Scan what the ledger has yet to see of ``docs``, one copy of each blob, and add it to the ledger.

    ``findings`` is written before ``seen``. A scan that stops in between is done anew by the next one; what it had found
    is then there twice, which ``ledger_findings`` merges.
    """
    spark = docs.sparkSession
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = docs.select(quoted(doc_id).alias("id"), _address(text).alias("blob")).groupBy("blob").agg(F.min("id").alias("rep"))
    unseen = blobs.withColumn("todo", keys)
    if _exists(spark, f"{ledger}/seen"):
        before = spark.read.parquet(f"{ledger}/seen").groupBy("blob").agg(F.flatten(F.collect_set("todo")).alias("done"))
        todo = F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))
        unseen = blobs.join(before, "blob", "left").select("blob", "rep", todo.alias("todo")).filter(F.size("todo") > 0)
    unseen = cut(unseen)
    if unseen.isEmpty() and _exists(spark, f"{ledger}/seen"):
        return

    texts = (
        docs.select(quoted(doc_id).alias("id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
        .withColumn("address", _address("text"))
        .join(unseen.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("address") == F.col("blob")))
    )
    find_spans(texts, rules).write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob", "todo").write.mode("append").parquet(f"{ledger}/seen")


def ledger_findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): what the ledger holds of the rules at their versions, a row for each blob with a finding."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    current = F.filter("spans", lambda s: F.array_contains(keys, s["rule"]))
    found = spark.read.parquet(f"{ledger}/findings").select("blob", F.explode(current).alias("span")).select("blob", "span.*")
    ranks = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.key, k)]), F.col("rule"))
    span = F.struct("start", ranks.alias("rank"), "kind", "end", "rule")
    return found.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def scan_secrets(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    ledger: str | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``blob`` (SHA-256 of the text, binary) and ``secrets`` (spans by start, then the rules' order).

    ``ledger``: the folder with the tables ``seen`` and ``findings``; what it holds is not scanned again, and the
    scan adds to it. None: a new ledger in the shared folder. A rule whose version is raised sees all blobs again;
    findings of rules that are not among ``rules`` at their version stay in the ledger and are not returned.

    A null text is an empty one; a text without finding has an empty list. Null and repeated ids, repeated rows and
    rows that share a text are all kept, each with the findings of its text. An empty table gives an empty table.
    Columns of ``docs`` named ``blob`` or ``secrets`` give way to the new ones.
    """
    spark = docs.sparkSession
    ledger = ledger or shared_path(spark, "secret-ledger")
    update_ledger(docs, ledger, rules, text, doc_id)
    findings = cut(ledger_findings(spark, ledger, rules))
    blob_, = fresh(docs, "blob_")
    kept = [quoted(c) for c in docs.columns if c.lower() not in ("blob", "secrets")]
    return (
        docs.select(*kept, _address(text).alias(blob_))
        .join(findings, F.col(blob_) == findings["blob"], "left")
        .select(*kept, F.col(blob_).alias("blob"), F.coalesce("spans", F.array().cast(FINDING)).alias("secrets"))
    )


def _exists(spark: SparkSession, table: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
