"""Rules for incoming batches of files; what breaks one goes to quarantine with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenledger.functions.names import extension
from lumenledger.sources.files import ALLOWED, MAX_FILE_BYTES, MAX_FILES


def judged(uploads: DataFrame, name: str = "name", length: str = "length", max_bytes: int = MAX_FILE_BYTES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Every row with its extension and the first rule that it breaks, null for none."""
    ext = extension(F.col(name))
    reason = F.when(~ext.isin(*allowed), "extension").when(F.coalesce(F.col(length), F.lit(0)) > max_bytes, "size").when(F.coalesce(F.col(length), F.lit(0)) == 0, "empty")
    return uploads.withColumn("extension", ext).withColumn("refused", reason)


def message(allowed: tuple[str, ...] = ALLOWED) -> Column:
    """What a refused extension is answered with: the column extension and those allowed, in order."""
    return F.concat(F.lit("."), F.col("extension"), F.lit(" is not allowed, only "), F.lit(", ".join(sorted(allowed))))


def as_images(taken: DataFrame, name: str = "name", length: str = "length") -> DataFrame:
    """Uploads that were taken (id, user_id, ...) as rows of the image table that wait for their turn."""
    return taken.select("id", "user_id", F.col(name).alias("original_filename"), F.concat(F.lit("in/"), F.col("id")).alias("original_path"), F.col(length).cast("int").alias("original_size_bytes"), F.lit("pending").alias("status"))


def split(uploads: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """(taken, quarantined)."""
    rows = judged(uploads, **rules)
    return rows.where("refused is null").drop("refused"), rows.where("refused is not null")


def oversized_batches(uploads: DataFrame, batch: str, most: int = MAX_FILES) -> DataFrame:
    """Requests with more files than one may bring."""
    return uploads.groupBy(batch).agg(F.count("*").alias("n_files")).where(F.col("n_files") > most)
