"""Point lookups and projections.  Filters reach the Parquet scan; owner scoping is part of the predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenledger.functions.names import download_name, media_type
from lumenledger.sources.schema import FETCHABLE

PROFILE = ("id", "email", "display_name", "is_active", "vault_salt")
STATUS = ("id", "status", "ssim_score", "psnr_score", "processing_time_ms", "error_message", "vault_sealed")
#: Columns of an image in a list.
LISTED = (
    "id", "original_filename", "status", "protection_strength", "width", "height", "original_size_bytes", "protected_size_bytes",
    "ssim_score", "psnr_score", "epsilon_used", "processing_time_ms", "error_message", "vault_sealed", "created_at",
)


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows whose key equals the value: at most two, so that a caller can tell one from several."""
    return df.where(F.col(key) == F.lit(value)).limit(2)


def at_most_one(df: DataFrame) -> dict | None:
    """The only row, or None; an error if there are two."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("several rows where one at most was expected")
    return rows[0].asDict() if rows else None


def owned(images: DataFrame, image_id: object, user_id: object) -> DataFrame:
    """One image, only for its owner."""
    return images.where((F.col("id") == F.lit(image_id)) & (F.col("user_id") == F.lit(user_id)))


def status_of(images: DataFrame, image_id: object, user_id: object) -> DataFrame:
    return owned(images, image_id, user_id).select(*STATUS)


def active(users: DataFrame) -> DataFrame:
    return users.where("is_active")


def files_of(images: DataFrame, where: Column | None = None) -> DataFrame:
    """Name and media type of every image that may be fetched: completed and failed ones."""
    rows = images.where(F.col("status").isin(*FETCHABLE))
    if where is not None:
        rows = rows.where(where)
    return rows.select(
        "id", download_name(F.col("original_filename"), F.col("vault_sealed")).alias("file_name"), media_type(F.col("vault_sealed")).alias("media_type")
    )


def resolved(requests: DataFrame, images: DataFrame, files: DataFrame) -> DataFrame:
    """Requests (image_id, user_id) for downloads, each with its outcome, and name and media type where it is ``found``.

    Another user's image is ``unknown``, like one that isn't there; one that isn't finished ``not ready``; one whose file isn't in the listing
    (path, ...) ``missing``.
    """
    # images without a path, most of them perhaps, are dealt by id: by path alone they would all be one task's
    at = lambda *c: F.xxhash64(F.coalesce(*c)).alias("__at")
    rows = images.select("id", F.col("user_id").alias("__owner"), "status", "protected_path", "original_filename", "vault_sealed", at("protected_path", F.col("id").cast("string")))
    listed = files.select(F.col("path").alias("__listed"), at("path").alias("__listed_at")).distinct()
    rows = rows.join(listed, (F.col("protected_path") == F.col("__listed")) & (F.col("__at") == F.col("__listed_at")), "left")
    outcome = F.when(~F.col("status").isin(*FETCHABLE), "not ready").when(F.col("__listed").isNull(), "missing").otherwise("found")
    taken = outcome == "found"
    judged = rows.select(
        "id", "__owner", outcome.alias("__outcome"),
        F.when(taken, download_name(F.col("original_filename"), F.col("vault_sealed"))).alias("file_name"), F.when(taken, media_type(F.col("vault_sealed"))).alias("media_type"),
    )
    held = requests.join(judged, (F.col("image_id") == F.col("id")) & (F.col("user_id") == F.col("__owner")), "left")
    return held.select("image_id", "user_id", F.coalesce("__outcome", F.lit("unknown")).alias("outcome"), "file_name", "media_type")


def existing(rows: DataFrame, path_col: str, files: DataFrame) -> DataFrame:
    """Rows whose file is in the listing (path, ...)."""
    listed = files.select(F.col("path").alias("__listed"))
    return rows.join(listed, F.col(path_col) == F.col("__listed"), "left_semi")


def as_json(df: DataFrame, name: str = "body") -> DataFrame:
    """Every row as one JSON document; nulls are written as nulls."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))
