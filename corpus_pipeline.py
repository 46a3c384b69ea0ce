"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes every stage's
result to the shared folder and reads it back, so lineage ends there.  All but the last return the columns of documents.

Null ids: the classifier scores such rows like any other; for line dedup they are one document below all others; near-dedup keeps
one of equal rows, and drops one that is near a row with an id; a benchmark item makes them go; they are packed.  Null
texts are empty ones: they are scored, link with nothing, and pack as one end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm import decontaminate, line_dedup, minhash, packing, quality
from lumenledger.llm.common import boxed, materialise, release, row_key, scratch_scope, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = boxed(docs, F.col("doc_id"), F.col("text"))
    return quality.score_documents(rows, net).where("predicted = 1").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in the one with the largest id."""
    left = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; repeated rows become one."""
    kept = minhash.near_duplicates(docs, with_key=True).where("kept").select(F.col("_key").alias("kept_key")).distinct()
    rows = boxed(docs, row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return rows.join(kept, F.col("key") == F.col("kept_key"), "left_semi").dropDuplicates(["key"]).select("row.*")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    marked = decontaminate.with_leaks(boxed(docs, F.col("text")), table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("leaks") == 0).select("row.*")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: SQL can't express the stages; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        # a stage's own scratch and its input go once its result is written
        with scratch_scope() as kept:
            docs = materialise(stage(spark, before, sf_dir), name)
            kept.append(docs)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
