"""From raw documents to token ids: what is toxic goes, shared lines go, one of each group of near copies stays, what holds
benchmark passages goes, and the rest is encoded.

Each stage reads what its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.bpe import encode
from loomstone.llm.decontaminate import drop_contaminated
from loomstone.llm.line_dedup import dedup_lines
from loomstone.llm.near_copies import drop_near_copies
from loomstone.llm.queries import word_vocabulary
from loomstone.llm.toxicity import drop_toxic
from loomstone.session import remove, shared_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go; ``n_chars`` follows."""
    return dedup_lines(docs).drop("n_lines", "n_dropped").withColumn("n_chars", F.length("text").cast("long"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word shingles at 0.8 or more alike, the document with the least id stays."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is encoded; texts stay beside their ids."""
    return encode(docs, word_vocabulary()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL states neither a trained classifier nor connected components; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again.

    A stage's table goes once its successor's is written; the last one's stays, for the result reads it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
