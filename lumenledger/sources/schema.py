"""Declared schemas of the two ledger tables, their defaults, and schema evolution on read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("pending", "processing", "completed", "failed", "quality_warning")
#: Statuses that the summary shows as pending.
WAITING = ("pending", "processing")
#: Statuses whose files may be fetched.
FETCHABLE = ("completed", "failed")

USERS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("email", T.StringType(), False),
        T.StructField("hashed_password", T.StringType(), False),
        T.StructField("display_name", T.StringType(), False),
        T.StructField("vault_salt", T.StringType(), False),
        T.StructField("is_active", T.BooleanType(), True),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

IMAGES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("original_filename", T.StringType(), False),
        T.StructField("original_path", T.StringType(), True),
        T.StructField("protected_path", T.StringType(), True),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("height", T.IntegerType(), False),
        T.StructField("original_size_bytes", T.IntegerType(), False),
        T.StructField("protected_size_bytes", T.IntegerType(), True),
        T.StructField("protection_strength", T.DoubleType(), False),
        T.StructField("epsilon_used", T.DoubleType(), True),
        T.StructField("eot_iterations", T.IntegerType(), False),
        T.StructField("watermark_id", T.StringType(), False),
        T.StructField("watermark_enabled", T.BooleanType(), False),
        T.StructField("vault_sealed", T.BooleanType(), False),
        T.StructField("ssim_score", T.DoubleType(), True),
        T.StructField("psnr_score", T.DoubleType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("error_message", T.StringType(), True),
        T.StructField("processing_time_ms", T.IntegerType(), True),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

#: Values of columns that a writer leaves out.
IMAGE_DEFAULTS: dict[str, object] = {
    "width": 0, "height": 0, "original_size_bytes": 0, "protection_strength": 0.5, "eot_iterations": 50, "watermark_id": "",
    "watermark_enabled": True, "vault_sealed": False, "status": "pending",
}
USER_DEFAULTS: dict[str, object] = {"display_name": "", "vault_salt": "", "is_active": True}


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: absent ones get their default, or null if they may be null."""
    out: list[Column] = []
    for f in schema.fields:
        if f.name in df.columns:
            value = F.col(f.name).cast(f.dataType)
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else value
        elif f.name in defaults:
            value = F.lit(defaults[f.name]).cast(f.dataType)
        elif f.name == "created_at":
            value = F.current_timestamp()
        elif f.nullable:
            value = F.lit(None).cast(f.dataType)
        else:
            raise ValueError(f"column {f.name} is required and has no default")
        out.append(value.alias(f.name))
    return df.select(*out)


def add_column(df: DataFrame, name: str, kind: str, default: object) -> DataFrame:
    """ADD COLUMN ... NOT NULL DEFAULT: a table that has it already stays, nulls of older files are filled."""
    value = F.lit(default).cast(kind)
    return df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
