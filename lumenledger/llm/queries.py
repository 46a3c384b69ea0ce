"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm import ann, decontaminate, html_text, line_dedup, minhash, packing, quality, repeats, sharding, simhash, spelling, warc, whitening
from lumenledger.llm.common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, net).select("doc_id", "held_out", "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    # what was just written reads back whole, or the query fails
    lost = F.raise_error(F.concat(F.lit("quarantined bytes in "), "file", F.lit(": "), "gap_reason")).cast("boolean")
    return back.where(F.when(F.col("record_type") == "gap", lost).otherwise(True)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.similarity", "leak.start", "leak.n_words")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("was"))
    left = line_dedup.dedup_lines(docs)
    before = F.coalesce("was", F.lit(""))
    return left.select(
        "doc_id",
        (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.col("_lost").alias("n_dropped"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_minhash": op1_minhash,
        "op2_ann": op2_ann,
        "op3_repeats": op3_repeats,
        "op4_packing": op4_packing,
        "op5_quality": op5_quality,
        "op6_warc": op6_warc,
        "op7_sharding": op7_sharding,
        "op8_decontamination": op8_decontamination,
        "op9_html": op9_html,
        "op10_line_dedup": op10_line_dedup,
        "op11_spelling": op11_spelling,
        "op12_whitening": op12_whitening,
        "op13_simhash": op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    from lumenledger.llm.oracle import ORACLES

    return dict(ORACLES)
