"""Files laid out for point lookups and for joins by owner, in place of a database's indexes.

* ``write_indexed``: Parquet with Bloom filters for columns that are looked up by value (email, id), so that a reader skips every row
  group that can't hold it, and rows clustered by range of another column (owner), whose statistics prune files and groups.
* ``write_bucketed``: a table bucketed by owner; users and images bucketed alike join without an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter


def _blooms(writer: DataFrameWriter, lookups: dict[str, int]) -> DataFrameWriter:
    for column, values in lookups.items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(values))
    return writer


def write_indexed(df: DataFrame, path: str, lookups: dict[str, int], cluster_by: tuple[str, ...] = (), files: int | None = None, group_bytes: int = 16 << 20, mode: str = "append") -> None:
    """Append ``df`` with a Bloom filter for each column of ``lookups``, sized for so many distinct values a row group.

    With ``cluster_by`` rows are dealt by ranges of these columns and sorted, so each file holds a range of them; ``files`` is their number, else
    Spark's.  Row groups are small, since a lookup reads whole ones.
    """
    dealt = df.repartitionByRange(*([files] if files else []), *cluster_by) if cluster_by else df
    rows = dealt.sortWithinPartitions(*cluster_by) if cluster_by else dealt
    _blooms(rows.write.mode(mode), lookups).option("parquet.block.size", str(group_bytes)).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, lookups: dict[str, int] | None = None) -> None:
    """Save ``df`` as a table of ``buckets`` buckets of ``key``, sorted within each; one file a bucket.

    Tables that are joined must have the same number.  Take it so that a bucket fits a task: input over 256 MB, say.
    """
    _blooms(df.repartition(buckets, key).write.mode("error").bucketBy(buckets, key).sortBy(key), lookups or {}).saveAsTable(table)
