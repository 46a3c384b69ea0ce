"""Exact search for vectors below a Euclidean distance, by pivots and rings.

Pivots are far apart vectors of a bounded sample.  A vector lies in the cell of its nearest pivot, in a ring of equal distance to it.  By
the triangle inequality a query at distance r of a vector differs from it by less than r in its distance to any pivot; so the query asks
only rings within r of its own distance, and no cell whose pivot is 2 r or more farther than its nearest.  Queries and vectors
then meet by (pivot, ring, part): an exchange on equal keys.  Rings of many are cut into parts by their counts, and a query asks every
part, so a ring that holds a third of all vectors is spread.

In a part, squared distances come from one matrix product; what is near the threshold or below it is measured again component by
component.  Nothing is lost whatever the pivots are; they decide how much is compared, which ``search_cost`` reports.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that pivots are chosen from, and pivots.
SAMPLE, PIVOTS = 2048, 64
#: Vectors of a part, and rows measured at a time.
PART, STEP = 4096, 512


def _clean(rows: DataFrame) -> DataFrame:
    v = F.col("vector")
    whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return rows.where(whole).select("id", v.cast("array<double>").alias("vector"))


def _stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y, up to rounding."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Each the one of a sample that is farthest from those before; the sample is fixed by the rows' content."""
    found = [r["vector"] for r in vectors.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").collect()]
    if not found:
        return np.zeros((0, 1))
    sizes = Counter(map(len, found))
    usual = max(sizes, key=lambda d: (sizes[d], d))
    x = np.array([v for v in found if len(v) == usual])
    chosen = [0]
    near = _apart(x, x[:1])[:, 0]
    while len(chosen) < min(pivots, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _apart(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _place(pivots: np.ndarray, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _apart(_stack(batch.column(1)), pivots)
                cell = d.argmin(1)
                ring = np.floor(d[np.arange(len(d)), cell] / width).astype(np.int64)
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(ring)], names=["id", "vector", "cell", "ring"])

    return run


def _ask(pivots: np.ndarray, width: float, below: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _apart(_stack(batch.column(1)), pivots)
            # distances are rounded, so reaches are a little wider
            slack = 1e-6 * (1 + d.max())
            row, cell = np.nonzero(d - d.min(1)[:, None] < 2 * below + slack)
            low = np.floor(np.maximum(d[row, cell] - below - slack, 0) / width).astype(np.int64)
            high = np.floor((d[row, cell] + below + slack) / width).astype(np.int64)
            yield pa.record_batch([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(low), pa.array(high)], names=["id", "vector", "cell", "low", "high"])

    return run


def _meet(below: float):
    """Rows sorted by (cell, ring, part, asks): the vectors of a part are held, queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, held, block = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, ring, part, asks = (np.asarray(batch.column(j)) for j in range(4))
            x = _stack(batch.column(5))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (ring[1:] != ring[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(x)).tolist()):
                key = (cell[a], ring[a], part[a])
                if key != last:
                    last, ids, held, block = key, [], [], None
                if not asks[a]:
                    ids.append(batch.column(4).slice(a, b - a))
                    held.append(x[a:b])
                    continue
                if not held:
                    continue
                if block is None:
                    block, names = np.concatenate(held), pa.concat_arrays(ids)
                for i in range(a, b, STEP):
                    q = x[i : min(b, i + STEP)]
                    near = _apart(q, block)
                    row, at = np.nonzero(near < below + 1e-6 * (1 + near.max()))
                    d = np.sqrt(((q[row] - block[at]) ** 2).sum(1))
                    row, at, d = row[d < below], at[d < below], d[d < below]
                    yield pa.record_batch([batch.column(4).take(pa.array(row + i)), names.take(pa.array(at)), pa.array(d)], names=["q_id", "id", "distance"])

    return run


def _keyed(queries: DataFrame, vectors: DataFrame, below: float, pivots: int, rings: int) -> tuple[DataFrame, DataFrame] | None:
    """Vectors (id, vector, cell, ring) and queries (id, vector, cell, ring) by key, or None if there is nothing to find."""
    vectors, queries = _clean(vectors), _clean(queries)
    chosen = choose_pivots(vectors, pivots)
    if not len(chosen):
        return None
    # only equal lengths can be compared; others are at no distance
    same = F.size("vector") == chosen.shape[1]
    width = below / rings
    kind = vectors.schema["id"].dataType.simpleString()
    placed = vectors.where(same).mapInArrow(_place(chosen, width), f"id {kind}, vector array<double>, cell int, ring long")
    kind = queries.schema["id"].dataType.simpleString()
    asking = queries.where(same).mapInArrow(_ask(chosen, width, below), f"id {kind}, vector array<double>, cell int, low long, high long")
    return placed, asking.select("id", "vector", "cell", F.explode(F.sequence("low", "high")).alias("ring"))


def _parts(placed: DataFrame, part: int) -> DataFrame:
    """(cell, ring, number of vectors, number of parts) of every ring that holds any."""
    counts = placed.groupBy(F.col("cell").alias("c"), F.col("ring").alias("r")).agg(F.count("*").alias("n"))
    return counts.withColumn("parts", F.ceil(F.col("n") / part).cast("long"))


def vector_search(queries: DataFrame, vectors: DataFrame, below: float, pivots: int = PIVOTS, rings: int = 2, part: int = PART) -> DataFrame:
    """For a stated query set all vectors at a Euclidean distance below a threshold: q_id, id, distance; columns id, vector.

    Vectors that are null, empty, not finite or of another length than most of the sample take no part.  Rings are ``below / rings`` wide.
    """
    if below <= 0:
        raise ValueError("the distance must be above 0")
    both = _keyed(queries, vectors, below, pivots, rings)
    kinds = {c: f.schema["id"].dataType.simpleString() for c, f in (("q_id", queries), ("id", vectors))}
    schema = f"q_id {kinds['q_id']}, id {kinds['id']}, distance double"
    if both is None:
        return queries.sparkSession.createDataFrame([], schema)
    if kinds["q_id"] != kinds["id"]:
        raise TypeError("ids of queries and vectors must be of one type")
    placed, asking = both
    parts = _parts(placed, part)
    on = lambda df: df.join(parts, (F.col("cell") == F.col("c")) & (F.col("ring") == F.col("r")))
    held = on(placed).select("cell", "ring", F.pmod(F.xxhash64("id", "vector"), F.col("parts")).alias("part"), F.lit(False).alias("asks"), "id", "vector")
    asked = on(asking).select("cell", "ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "id", "vector")
    dealt = held.unionByName(asked).repartition("cell", "ring", "part").sortWithinPartitions("cell", "ring", "part", "asks")
    return dealt.mapInArrow(_meet(below), schema)


def search_cost(queries: DataFrame, vectors: DataFrame, below: float, pivots: int = PIVOTS, rings: int = 2) -> DataFrame:
    """One row: how many pairs ``vector_search`` compares, and how many there are."""
    both = _keyed(queries, vectors, below, pivots, rings)
    if both is None:
        return queries.sparkSession.createDataFrame([(0, 0)], "compared long, pairs long")
    placed, asking = both
    asked = asking.groupBy("cell", "ring").agg(F.count("*").alias("asked"))
    met = asked.join(_parts(placed, PART), (F.col("cell") == F.col("c")) & (F.col("ring") == F.col("r")))
    all_pairs = _clean(queries).agg(F.count("*").alias("q")).join(_clean(vectors).agg(F.count("*").alias("v")))
    return met.agg(F.coalesce(F.sum(F.col("asked") * F.col("n")), F.lit(0)).alias("compared")).join(all_pairs).select("compared", (F.col("q") * F.col("v")).alias("pairs"))
