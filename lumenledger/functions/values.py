"""Small scalar rules: identifiers, times, settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def as_uuid(text: Column) -> Column:
    """The identifier in lower case, or null for anything that isn't one (braces, a urn prefix and missing dashes are taken)."""
    bare = F.regexp_replace(F.lower(text), r"^(urn:uuid:)?\{?|\}?$", "")
    hexed = F.regexp_replace(bare, "-", "")
    dashed = F.regexp_replace(hexed, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(dashed.rlike(_UUID), dashed)


def new_id() -> Column:
    """A random identifier for each row, of version 4."""
    return F.expr("uuid()")


def has_prefix(text: Column, *prefixes: str) -> Column:
    """Whether the text begins with one of the prefixes; false for null."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(text, F.lit(p))
    return F.coalesce(found, F.lit(False))


def expiry(issued: Column, minutes: int) -> Column:
    return issued + F.make_interval(mins=F.lit(minutes))


def elapsed_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds, cut off and not rounded; the arguments are seconds."""
    return ((ended - started) * F.lit(1000.0)).cast("int")
