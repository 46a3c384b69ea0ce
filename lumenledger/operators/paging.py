"""Newest-first pages.

Rows of equal age are ordered by falling id, so pages over equal timestamps neither repeat nor miss rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE = 20


def bounds(page: int, page_size: int = PAGE_SIZE) -> tuple[int, int]:
    """(offset, limit); pages below 1 are page 1, negative sizes are refused."""
    if page_size < 0:
        raise ValueError("page_size must not be negative")
    return (max(1, page) - 1) * page_size, page_size


def page_of(images: DataFrame, user_id: object, page: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of a user's images: planned as one top-k of offset + limit rows, not a full sort."""
    offset, limit = bounds(page, page_size)
    rows = images.where(F.col("user_id") == F.lit(user_id)).orderBy(F.desc("created_at"), F.desc("id"))
    return rows.offset(offset).limit(limit)


def total_of(images: DataFrame, user_id: object) -> DataFrame:
    return images.where(F.col("user_id") == F.lit(user_id)).agg(F.count("*").alias("total"))


def response(images: DataFrame, user_id: object, page: int, page_size: int, *columns: str) -> DataFrame:
    """The whole answer in one row: images (a list of structs, newest first), total, and page and page_size as they were asked for."""
    shown = page_of(images, user_id, page, page_size)
    rows = shown.agg(F.collect_list(F.struct("created_at", "id", F.struct(*columns).alias("image"))).alias("rows"))  # a page at most
    newest = F.reverse(F.array_sort("rows"))
    return rows.join(F.broadcast(total_of(images, user_id))).select(F.transform(newest, lambda r: r["image"]).alias("images"), "total", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"))


def page_of_all(images: DataFrame, page: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """The same page for every user; rows beyond it are dropped before the exchange (window group limit)."""
    offset, limit = bounds(page, page_size)
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = images.withColumn("position", F.row_number().over(newest))
    return ranked.where(F.col("position") <= offset + limit).where(F.col("position") > offset)
