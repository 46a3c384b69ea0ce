"""Users and their images: eager loads, nesting, cascades, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def images_of(images: DataFrame, users: DataFrame) -> DataFrame:
    """All images of the given users, in one batch."""
    keys = users.select(F.col("id").alias("__user"))
    return images.join(keys, F.col("user_id") == F.col("__user"), "left_semi")


def with_owner(images: DataFrame, users: DataFrame, *columns: str) -> DataFrame:
    owner = users.select(F.col("id").alias("__user"), *[F.col(c).alias(f"owner_{c}") for c in columns])
    return images.join(owner, F.col("user_id") == F.col("__user")).drop("__user")


def nested(users: DataFrame, images: DataFrame, *columns: str) -> DataFrame:
    """Each user with an array of images, sorted by the columns given; empty for none.

    An array is as long as a user has images, so this is for users read by key or in pages.
    """
    lists = images.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("images"))
    kind = dict(lists.dtypes)["images"]
    joined = users.join(lists, F.col("id") == F.col("user_id"), "left").drop("user_id")
    return joined.withColumn("images", F.coalesce("images", F.expr(f"cast(array() as {kind})")))


def orphans(images: DataFrame, users: DataFrame) -> DataFrame:
    """Images whose user is missing."""
    keys = users.select(F.col("id").alias("__user"))
    return images.join(keys, F.col("user_id") == F.col("__user"), "left_anti")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
