"""Inserts, updates and deletes as new versions of a table.

Nothing is changed in place: an update overlays a keyed set of new values, a delete is an anti join, and
``commits`` writes the result as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE_CHARS = 500


def overlay(df: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of ``df`` with the values of ``changes`` (unique by key) where it has the key; nulls are values too."""
    new = changes.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """UPDATE ... SET ... WHERE as a projection."""
    return df.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def mark_processing(images: DataFrame, where: Column) -> DataFrame:
    return update(images, where, status=F.lit("processing"))


def mark_failed(images: DataFrame, where: Column, message: Column) -> DataFrame:
    """Status and message; times and scores stay as they are."""
    return update(images, where, status=F.lit("failed"), error_message=F.substring(message, 1, MESSAGE_CHARS))


def persist_results(images: DataFrame, results: DataFrame) -> DataFrame:
    """Overlay of finished jobs: id, status, scores, time, size."""
    return overlay(images, results, "id", *[c for c in results.columns if c != "id"])


def seal(images: DataFrame, where: Column, sealed_bytes: Column, path: Column) -> DataFrame:
    """Seal images that aren't yet, whatever their status; sealed ones keep their file and its size."""
    return update(images, where & ~F.col("vault_sealed"), vault_sealed=F.lit(True), protected_size_bytes=sealed_bytes, protected_path=path)


def delete_owned(images: DataFrame, requests: DataFrame) -> DataFrame:
    """Without the images asked for (image_id, user_id) by their owners; nobody deletes another's."""
    gone = requests.select(F.col("image_id").alias("__id"), F.col("user_id").alias("__user"))
    return images.join(gone, (F.col("id") == F.col("__id")) & (F.col("user_id") == F.col("__user")), "left_anti")


def backfill_salt(users: DataFrame, salt: Column) -> DataFrame:
    """Give a salt to users that have none."""
    return update(users, F.col("vault_salt") == "", vault_salt=salt)


def random_salt() -> Column:
    """32 bytes as 64 hex digits, a digest of two random UUIDs (from the JVM's secure generator) for each row."""
    return F.sha2(F.concat(F.expr("uuid()"), F.expr("uuid()")).cast("binary"), 256)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``keys``."""
    gone = keys.select(F.col(key).alias("__gone"))
    return df.join(gone, F.col(key) == F.col("__gone"), "left_anti")


def purge(images: DataFrame, user_id: object) -> DataFrame:
    """Without the images of a user."""
    return images.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def terminate(users: DataFrame, images: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users without those gone, and images without theirs: the cascade."""
    ids = gone.select(F.col("id").alias("user_id"))
    return delete(users, gone, "id"), delete(images, ids, "user_id")


def register(users: DataFrame, new: DataFrame, key: str = "email") -> DataFrame:
    """``users`` with the new ones whose key is free; of equal new keys the smallest id comes in."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), "id").alias("__row")).select("__row.*")
    held = users.select(F.col(key).alias("__held"))
    return users.unionByName(first.join(held, F.col(key) == F.col("__held"), "left_anti"), allowMissingColumns=True)
