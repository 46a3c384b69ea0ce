"""Membership in a set of known values: exactly by a semi join, or by a Bloom filter in parts as a first sieve.

The filter is a table of parts, each ``PART_BITS`` bits (128 KB), whatever the number of values: a value's hash names its part, and its
bits lie in that part.  Building, joining generations and probing are exchanges by part; nothing is broadcast or collected.  A part with
many probes is given to several tasks, each with a copy of its bits, so a value that a third of all rows hold is spread.

Generations.  A scheduled rebuild sets the bits of what is new only and joins them to the last generation by OR, then commits the result
as a version (``commits``).  A generation keeps its size: past its capacity the error rate grows, which ``fill`` shows, and a full
rebuild takes a larger size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.operators import commits

MIN_CAPACITY = 10_000
#: Bits of a part, and probes of a part that one task takes.
PART_BITS = 1 << 20
PROBES = 200_000
SCHEMA = "part int, bits binary"


def known(rows: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """Rows whose value is held."""
    keys = held.select(F.col(column).alias("__held"))
    return rows.join(keys, F.col(column) == F.col("__held"), "left_semi")


@dataclass(frozen=True)
class Sizing:
    """How large a filter is: parts and bits set for each value, from capacity and error rate by the public formulas."""

    parts: int
    hashes: int

    @staticmethod
    def of(expected: int, rate: float = 0.001) -> Sizing:
        capacity = max(expected, MIN_CAPACITY)
        bits = -capacity * math.log(rate) / math.log(2) ** 2
        return Sizing(math.ceil(bits / PART_BITS), max(1, round(-math.log2(rate))))

    def spots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The bits of values within their part, by double hashing."""
        step = two.view(np.uint64) | np.uint64(1)
        at = one.view(np.uint64)[:, None] + step[:, None] * np.arange(self.hashes, dtype=np.uint64)
        return (at >> np.uint64(7)) % np.uint64(PART_BITS)


def _hashes(value: Column, sizing: Sizing) -> list[Column]:
    """Part and two hashes of a value."""
    return [F.pmod(F.xxhash64(value, F.lit(3)), F.lit(sizing.parts)).cast("int").alias("part"), F.xxhash64(value, F.lit(1)).alias("one"), F.xxhash64(value, F.lit(2)).alias("two")]


def _runs(part: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    yield from zip(np.append(0, cuts).tolist(), np.append(cuts, len(part)).tolist())


def _set_bits(sizing: Sizing):
    """Hashed values sorted by part -> one row a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bits = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, one, two = (np.asarray(c) for c in batch.columns)
            for a, b in _runs(part):
                if part[a] != last:
                    if bits is not None:
                        yield _part(last, bits)
                    last, bits = part[a], np.zeros(PART_BITS // 8, np.uint8)
                at = sizing.spots(one[a:b], two[a:b]).ravel()
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if bits is not None:
            yield _part(last, bits)

    return run


def _part(part: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part -> one row a part, the OR of its bits."""
    last, bits = None, None
    for batch in batches:
        for part, more in zip(batch.column(0).to_pylist(), batch.column(1)):
            more = np.frombuffer(more.as_py(), np.uint8)
            if part != last:
                if bits is not None:
                    yield _part(last, bits)
                last, bits = part, more
            else:
                bits = bits | more
    if bits is not None:
        yield _part(last, bits)


def merge(*generations: DataFrame) -> DataFrame:
    """Filters of one sizing as one that holds what any of them holds."""
    rows = generations[0]
    for g in generations[1:]:
        rows = rows.unionByName(g)
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_either, SCHEMA)


def build(held: DataFrame, column: str, sizing: Sizing) -> DataFrame:
    """The filter (part, bits) of a column's values; nulls are left out, parts without any value have no row.

    Values are made distinct first, in each task before any exchange, so one that is everywhere is a row a task.
    """
    rows = held.where(F.col(column).isNotNull()).select(*_hashes(F.col(column), sizing)).distinct()
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_set_bits(sizing), SCHEMA)


def _test(sizing: Sizing):
    """Rows sorted by (part, copy, probe): the bits of a part, then its probes, which get their answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bits = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, copy, probe = (np.asarray(batch.column(j)) for j in range(3))
            hit = np.zeros(len(part), bool)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (copy[1:] != copy[:-1]) | (probe[1:] != probe[:-1])) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(part)).tolist()):
                if (part[a], copy[a]) != last:
                    last, bits = (part[a], copy[a]), None
                if not probe[a]:
                    bits = np.frombuffer(batch.column(5)[a].as_py(), np.uint8)
                elif bits is not None:
                    one, two = (np.asarray(batch.column(j).slice(a, b - a)) for j in (3, 4))
                    at = sizing.spots(one, two)
                    hit[a:b] = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
            take = pa.array(np.flatnonzero(probe))
            yield pa.record_batch([batch.column(6).take(take), pa.array(hit[probe])], names=["row", "might_contain"])

    return run


def probe(rows: DataFrame, column: str, bits: DataFrame, sizing: Sizing, each: int = PROBES) -> DataFrame:
    """``rows`` with might_contain: never false for a held value, true for others at the error rate; null for null."""
    beside = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    asked = rows.where(F.col(column).isNotNull()).select(*_hashes(F.col(column), sizing), beside)
    copies = asked.groupBy(F.col("part").alias("p")).agg(F.ceil(F.count("*") / each).cast("int").alias("copies"))
    none = F.lit(None)
    row_type = asked.schema["row"].dataType
    held = bits.join(copies, F.col("part") == F.col("p"))
    held = held.select("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("probe"), none.cast("long").alias("one"), none.cast("long").alias("two"), "bits", none.cast(row_type).alias("row"))
    asked = asked.join(copies, F.col("part") == F.col("p")).select("part", F.pmod(F.monotonically_increasing_id(), F.col("copies")).cast("int").alias("copy"), F.lit(True).alias("probe"), "one", "two", none.cast("binary").alias("bits"), "row")
    dealt = held.unionByName(asked).repartition("part", "copy").sortWithinPartitions("part", "copy", "probe")
    told = dealt.mapInArrow(_test(sizing), f"row {row_type.simpleString()}, might_contain boolean").select("row.*", "might_contain")
    return told.unionByName(rows.where(F.col(column).isNull()).withColumn("might_contain", none.cast("boolean")))


def fill(bits: DataFrame, sizing: Sizing) -> DataFrame:
    """One row: parts held, the largest share of bits set in any, and the error rate that this implies there."""

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [int(np.bitwise_count(np.frombuffer(b.as_py(), np.uint8)).sum()) for b in batch.column(1)]
            yield pa.record_batch([pa.array(counts, pa.int64())], names=["ones"])

    share = F.coalesce(F.max("ones") / PART_BITS, F.lit(0.0))
    counted = bits.mapInArrow(ones, "ones long")
    return counted.agg(F.count("*").alias("parts"), share.alias("fullest"), F.pow(share, F.lit(float(sizing.hashes))).alias("error_rate"))


def rebuild(spark: SparkSession, root: str, new: DataFrame, column: str, sizing: Sizing) -> int:
    """One scheduled run: the bits of new values joined to the current generation and committed; the generation's number.

    Of two runs at once one is applied on top of the other.
    """
    added = build(new, column, sizing)
    return commits.transact(spark, root, lambda last: merge(last, added), action="rebuild", schema=added.schema)
