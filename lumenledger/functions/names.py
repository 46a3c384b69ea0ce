"""File names: extension, base, and the name under which a file is handed out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; ``unknown`` without a dot or for null."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit("unknown"))


def base(name: Column) -> Column:
    """The name without its last extension; leading dots belong to the name."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def download_name(name: Column, sealed: Column, prefix: str = "protected_") -> Column:
    """Prefix, base and the ending that the seal asks for."""
    return F.concat(F.lit(prefix), base(name), F.when(sealed, ".enc").otherwise(".png"))


def media_type(sealed: Column) -> Column:
    return F.when(sealed, "application/octet-stream").otherwise("image/png")


def allowed_set(text: str) -> frozenset[str]:
    """A setting like ``jpg, PNG ,webp`` as a set."""
    return frozenset(x.strip().lower() for x in text.split(",") if x.strip())
