"""From raw documents to a mixed training set: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. Null and empty texts, null ids, languages and
sources, repeated rows, empty tables and columns beyond those of documents are
allowed; each stage says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.llm import decontaminate, line_runs, mixing, robust_rules, simhash
from foretell.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them.

    Null languages and sources are cells of their own; repeated rows are judged
    alike; other columns than those of documents are left behind here.
    """
    return robust_rules.judge(docs).where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; documents of which nothing but white space is left go.

    Repeated rows (same id and text) are one document to it and stay alike; null
    ids come first, and null texts, of which nothing is cut, stay null.
    """
    cut = line_runs.dedup_lines(docs)
    left = cut.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in COLUMNS])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: fingerprints within two bits, or four fifths of the five-word shingles in common.

    Rows repeated in id and text are copies of each other; of ids that repeat
    with other texts each row is judged by its text; a null id is kept only
    where its group has no other.
    """
    return simhash.keep_representatives(docs).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none, and without items nothing goes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items).select(COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the source weights take, with their epoch and the number of tokens to use; wordless texts are never taken."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Fingerprints and block-max retrieval can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; stage results lie in the shared folder of ``spark.checkpoint.dir``, whose owner clears it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{n}-{name}")
    return docs
