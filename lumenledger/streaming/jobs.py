"""The background queue as a stream: each micro-batch of queued rows is processed and its results are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumenledger.operators.mutate import MESSAGE_CHARS

SSIM_FLOOR = 0.95


def outcome(ssim, error):
    """Status of a finished job: failed with an error, a warning below the similarity floor, else completed."""
    return F.when(error.isNotNull(), "failed").when(ssim < F.lit(SSIM_FLOOR), "quality_warning").otherwise("completed")


def finished(batch: DataFrame) -> DataFrame:
    """Jobs (id, ssim_score, psnr_score, started, ended, error) as results to overlay."""
    elapsed = F.expr("cast((unix_micros(ended) - unix_micros(started)) div 1000 as int)")
    return batch.select(
        "id", outcome(F.col("ssim_score"), F.col("error")).alias("status"), "ssim_score", "psnr_score",
        elapsed.alias("processing_time_ms"), F.substring("error", 1, MESSAGE_CHARS).alias("error_message"),
    )


def run_queue(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = finished, once: bool = True) -> StreamingQuery:
    """Watch a folder of Parquet files of jobs; every batch goes through ``work`` to its own folder of ``sink``.

    A batch that is tried again overwrites its folder, so results come exactly once.
    """

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
