"""Perceptual hashes: shape, dedup, Hamming joins, and a cascade of match strategies.

A 64-bit hash is kept as two 32-bit halves (hi, lo) in longs.  Thresholds are parameters.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = r"^[0-9a-f]{16}$"


def well_formed(h: Column) -> Column:
    return F.coalesce(h.rlike(HASH), F.lit(False))


def halves(h: Column) -> tuple[Column, Column]:
    """The halves of 16 hex digits."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")


def distance(a: str, b: str) -> Column:
    """Hamming distance of hashes with prefixes a and b."""
    return (F.bit_count(F.col(f"{a}hi").bitwiseXOR(F.col(f"{b}hi"))) + F.bit_count(F.col(f"{a}lo").bitwiseXOR(F.col(f"{b}lo")))).cast("int")


def dedupe(entries: DataFrame, target: DataFrame | None = None, kind: str = "hash_kind", value: str = "phash", order: str = "id") -> DataFrame:
    """The first entry by ``order`` of each (kind, hash), without blank kinds and null hashes, and without those held already."""
    rows = entries.where((F.coalesce(F.trim(kind), F.lit("")) != "") & F.col(value).isNotNull())
    first = rows.groupBy(kind, value).agg(F.min(order).alias(order))
    if target is None:
        return first
    held = target.select(F.col(kind).alias("__k"), F.col(value).alias("__v"))
    return first.join(held, (F.col(kind) == F.col("__k")) & (F.col(value) == F.col("__v")), "left_anti")


def bands(hi: Column, lo: Column, count: int) -> list[Column]:
    """The 64 bits cut into ``count`` runs, each as a long."""
    edges = [64 * i // count for i in range(count + 1)]
    out = []
    for a, b in zip(edges, edges[1:]):
        parts = []
        for half, start in ((hi, 0), (lo, 32)):
            lo_bit, hi_bit = max(a, start), min(b, start + 32)
            if lo_bit < hi_bit:
                width = hi_bit - lo_bit
                parts.append((F.shiftright(half, start + 32 - hi_bit).bitwiseAND((1 << width) - 1), width))
        value = F.lit(0).cast("long")
        for part, width in parts:
            value = F.shiftleft(value, width).bitwiseOR(part)
        out.append(value)
    return out


def keys(hi: Column, lo: Column, most: int) -> Column:
    """(pair of bands, value) of all pairs of ``most + 2`` bands: hashes within ``most`` bits agree in two bands at least.

    Two bands hold 2 * 64 / (most + 2) bits, so unrelated hashes meet far more rarely than in single bands, and a value
    that is common in one band is spread by the other.
    """
    cut = bands(hi, lo, most + 2)
    return F.posexplode(F.array(*[F.struct(a, b) for a, b in itertools.combinations(cut, 2)]))


#: With this many bits a key has 64 * 2 / (MOST + 2) = 12 bits and a hash 36 keys.  Beyond it keys are so short that most pairs would meet.
MOST = 8


def _check(most: int) -> None:
    if not 0 <= most <= MOST:
        raise ValueError(f"most must be from 0 to {MOST}; wider distances need another index than pairs of bands")


def near_pairs(hashes: DataFrame, most: int, key: str = "id") -> DataFrame:
    """Pairs (a, b, distance) of distinct hashes within ``most`` bits, each by its smallest key; columns key, hi, lo.

    An equi-join on pairs of bands finds all pairs (pigeonhole); the exact distance is part of the join.  Equal hashes are
    one row before the join.
    """
    _check(most)
    rows = hashes.groupBy("hi", "lo").agg(F.min(key).alias("id"))
    cut = keys(F.col("hi"), F.col("lo"), most).alias("band", "value")
    left = rows.select("id", "hi", "lo", cut).select(*[F.col(c).alias(f"a_{c}") for c in ("id", "hi", "lo", "band", "value")])
    right = rows.select("id", "hi", "lo", cut).select(*[F.col(c).alias(f"b_{c}") for c in ("id", "hi", "lo", "band", "value")])
    apart = distance("a_", "b_")
    joined = left.join(right, (F.col("a_band") == F.col("b_band")) & (F.col("a_value") == F.col("b_value")) & (F.col("a_id") < F.col("b_id")) & (apart <= most))
    return joined.select("a_id", "b_id", apart.alias("distance")).distinct()


def classes(hashes: DataFrame, key: str = "id") -> DataFrame:
    """Each row's key with the key that stands for its hash in ``near_pairs``."""
    rows = hashes.groupBy("hi", "lo").agg(F.min(key).alias("class_id"))
    return hashes.select(key, "hi", "lo").join(rows, ["hi", "lo"]).select(key, "class_id")


def search(queries: DataFrame, hashes: DataFrame, most: int) -> DataFrame:
    """For a stated query set all hashes within ``most`` bits: q_id, id, distance."""
    _check(most)
    cut = lambda: keys(F.col("hi"), F.col("lo"), most).alias("band", "value")
    q = queries.select("id", "hi", "lo", cut()).select(*[F.col(c).alias(f"q_{c}") for c in ("id", "hi", "lo", "band", "value")])
    h = hashes.select("id", "hi", "lo", cut()).select(*[F.col(c).alias(f"h_{c}") for c in ("id", "hi", "lo", "band", "value")])
    apart = distance("q_", "h_")
    found = q.join(h, (F.col("q_band") == F.col("h_band")) & (F.col("q_value") == F.col("h_value")) & (apart <= most))
    return found.select("q_id", F.col("h_id").alias("id"), apart.alias("distance")).distinct()


def candidates(full: Column, *crops: Column) -> Column:
    """Hashes to look for, the whole image's first, then those of its crops; each once, none null."""
    return F.array_compact(F.array_distinct(F.array(full, *crops)))


def cascade(*strategies: tuple[str, DataFrame]) -> DataFrame:
    """The first strategy that finds anything for a query, with its nearest find: q_id, id, distance, method.

    Each strategy is a frame (q_id, id, distance); ties in distance go to the smaller id.
    """
    ranked = None
    for place, (name, found) in enumerate(strategies):
        rows = found.select("q_id", "id", F.col("distance").cast("double").alias("distance"), F.lit(place).alias("place"), F.lit(name).alias("method"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = ranked.groupBy("q_id").agg(F.min(F.struct("place", "distance", "id", "method")).alias("b"))
    return best.select("q_id", F.col("b.id").alias("id"), F.col("b.distance").alias("distance"), F.col("b.method").alias("method"))
