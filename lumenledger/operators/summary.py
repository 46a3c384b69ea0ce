"""Dashboard aggregates: one scan of conditional aggregates in place of three statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenledger.functions.rounding import half_up, none_if_zero
from lumenledger.sources.schema import WAITING


def _measures() -> list[Column]:
    """Counts by bucket, and over completed rows the averages and sums.

    Rows with a quality warning count in the total and in nothing else.  Averages of exactly 0 show as null; sums over
    nothing are 0.
    """
    done = F.col("status") == "completed"
    sums = {"total_original_bytes": "original_size_bytes", "total_protected_bytes": "protected_size_bytes", "total_processing_time_ms": "processing_time_ms"}
    return [
        F.count("*").alias("total_images"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin(*WAITING)).alias("pending"),
        half_up(none_if_zero(F.avg(F.when(done, F.col("ssim_score")))), 4).alias("avg_ssim"),
        half_up(none_if_zero(F.avg(F.when(done, F.col("psnr_score")))), 2).alias("avg_psnr"),
        *[F.coalesce(F.sum(F.when(done, F.col(c)).cast("long")), F.lit(0)).cast("long").alias(name) for name, c in sums.items()],
    ]


def summary_of(images: DataFrame, user_id: object) -> DataFrame:
    """Exactly one row, also for a user without images."""
    return images.where(F.col("user_id") == F.lit(user_id)).agg(*_measures())


def summary_of_all(users: DataFrame, images: DataFrame) -> DataFrame:
    """One row a user, zeros for those without images.  Images are aggregated before they meet users."""
    per_user = images.groupBy("user_id").agg(*_measures())
    joined = users.select("id").join(per_user, F.col("id") == F.col("user_id"), "left")
    counts = [c for c in per_user.columns if c not in ("user_id", "avg_ssim", "avg_psnr")]
    return joined.select(F.col("id").alias("user_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "avg_ssim", "avg_psnr")


def response(row: dict) -> dict:
    """The summary as an API answer: averages are rounded as Python rounds, from unrounded ones."""
    return row | {k: (round(row[k], d) if row.get(k) else None) for k, d in (("avg_ssim", 4), ("avg_psnr", 2))}


def by_status(images: DataFrame) -> DataFrame:
    return images.groupBy("status").agg(F.count("*").alias("n"))
