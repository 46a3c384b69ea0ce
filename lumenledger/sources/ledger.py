"""The ledger's tables: written ones, and the adapter that shows the test tables in their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenledger.sources.schema import IMAGE_DEFAULTS, IMAGES, USER_DEFAULTS, USERS, conform

#: Column -> expression over the test table customer; the same text is valid in Spark and DuckDB.
USER_COLUMNS = {
    "id": "c_custkey",
    "email": "concat(lower(c_name), '@example.com')",
    "display_name": "c_name",
    "segment": "c_mktsegment",
    "is_active": "c_acctbal >= 0e0",
    "vault_salt": "case when c_custkey % 5 = 0 then '' else md5(cast(c_custkey as string)) end",
}

#: Column -> expression over the test table orders.
IMAGE_COLUMNS = {
    "id": "o_orderkey",
    "user_id": "o_custkey",
    "created_at": "o_orderdate",
    "status": """case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then 'quality_warning'
        when o_orderstatus = 'F' then 'completed'
        when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then 'failed'
        when o_orderstatus = 'P' then 'processing' else 'pending' end""",
    "ssim_score": """case when o_orderstatus = 'F' then
        (case when o_orderpriority = '5-LOW' then 0.90e0 else 0.95e0 end) + (o_orderkey % 50) / 1000e0 end""",
    "psnr_score": "case when o_orderstatus = 'F' then 30e0 + (o_orderkey % 120) / 10e0 end",
    "processing_time_ms": "case when o_orderstatus = 'F' then cast(o_orderkey % 30000 as int) end",
    "original_size_bytes": "cast(floor(o_totalprice) as int)",
    "protected_size_bytes": "case when o_orderstatus = 'F' then cast(floor(o_totalprice / 2e0) as int) end",
    "vault_sealed": "(o_orderkey % 3 = 0 and o_orderstatus = 'F')",
    "width": "cast(200 + o_orderkey % 1800 as int)",
    "height": "cast(100 + o_orderkey % 900 as int)",
    "protection_strength": "(o_orderkey % 10) / 10e0",
    "epsilon_used": "case when o_orderstatus = 'F' then (1 + o_orderkey % 16) / 255e0 end",
    "error_message": """case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then concat('no face in ', cast(o_orderkey as string)) end""",
    "original_path": "case when o_orderstatus <> 'F' then concat('in/', cast(o_orderkey as string)) end",
    "protected_path": "case when o_orderstatus = 'F' then concat('store/', cast(o_orderkey as string)) end",
    "original_filename": """concat('shot', cast(o_orderkey as string), case o_orderkey % 5 when 0 then '.PNG' when 1 then '.jpeg'
        when 2 then '.tar.webp' when 3 then '' else '.' end)""",
}


def _read(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test customers as users."""
    return _read(spark, sf_dir, "customer", USER_COLUMNS)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test orders as images."""
    return _read(spark, sf_dir, "orders", IMAGE_COLUMNS)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """A written user table; files older than a column show its default."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path), USERS, USER_DEFAULTS)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A written image table; files older than a column show its default."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path), IMAGES, IMAGE_DEFAULTS)


def append_images(df: DataFrame, path: str) -> None:
    """Insert a batch: rows clustered by owner, so that a lookup by user prunes row groups by their statistics."""
    conform(df, IMAGES, IMAGE_DEFAULTS).sortWithinPartitions("user_id", "created_at").write.mode("append").parquet(path)


def append_users(df: DataFrame, path: str) -> None:
    conform(df, USERS, USER_DEFAULTS).write.mode("append").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A live database table in ``parts`` ranges of a numeric key, read side by side."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
        .load()
    )
