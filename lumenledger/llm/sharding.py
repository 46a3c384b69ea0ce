"""Reproducible sharding: a Feistel permutation of global row numbers.

Rows are numbered from 0 in the order of (id, checksum, size), which doesn't depend on files or partitions.
A keyed Feistel network permutes the smallest even-bit domain that holds all numbers, and cycle walking (feeding
a value back until it falls below the row count) restricts it to them.  The permuted number gives the place:
shard = number mod shards, slot = number div shards.  So shard and slot of any row can be computed from its number
alone, slots have no gaps, and shard sizes differ by one row at most: the law is ``rows``.

Numbering moves only id, checksum and size (20 bytes a row), never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import byte_length, mix64, number_rows, utf8

ROUNDS = 6


def feistel(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A permutation of 0..n-1 applied to ``numbers``: balanced Feistel rounds with cycle walking.

    The domain is below 4n, so a value walks four steps on average.
    """
    if n <= 1:
        return np.zeros(len(numbers), np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

        def once(x: np.ndarray) -> np.ndarray:
            left, right = x >> shift, x & mask
            for key in keys:
                left, right = right, left ^ (mix64(right + key) & mask)
            return (left << shift) | right

        out = once(np.asarray(numbers).astype(np.uint64))
        walking = np.flatnonzero(out >= np.uint64(n))
        while walking.size:
            out[walking] = once(out[walking])
            walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into ``shards`` shards: columns id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 1; a null text has size 1 and checksum 0.  grown_shard is null: under
    the law ``rows`` a further shard moves rows among all shards.  Rows with equal id, text and size get neighbouring
    numbers and so places of their own; which of them gets which doesn't show.  Null ids sort first.  An empty table
    gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    slim = docs.select(
        F.col(id_col).alias("_id"),
        (byte_length(F.col(text_col)) + 1).alias("size"),
        F.crc32(utf8(F.col(text_col))).alias("text_crc32"),
    )
    # the last key tells equal rows apart, so that many of them spread over partitions; it is the same in every scan
    numbered, n = number_rows(slim.withColumn("_tie", F.monotonically_increasing_id()), "_id", "text_crc32", "size", "_tie")

    @F.pandas_udf("long")
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel(numbers.to_numpy(), n, seed))

    return numbered.withColumn("_to", permuted("_row")).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("_to", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_to div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
