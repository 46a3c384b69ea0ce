"""Nearest neighbours by multi-index hashing on learned rotated binary codes.

Codes.  Vectors are given one more coordinate, sqrt(M**2 - |x|**2), that turns largest inner product into smallest
angle.  Orthogonal rotations are learned on a bounded sample (iterative quantisation: alternate between signs and the
Procrustes rotation onto them), and the signs of rotated coordinates are the code of ``TABLES * WIDTH`` bits.

Index.  Every distinct vector is indexed, in one block of the base; the code is split into ``TABLES`` substrings of ``WIDTH`` bits,
each with its own table from value to codes.  A query looks up all values that differ from its own substring in no more bits than the
table's reach.  By the pigeonhole principle this retrieves every code within Hamming radius sum(reach + 1) - 1: a code beyond
the reach in every table is further away than that.  Codes found are checked on the whole code against a second, wider radius
and reranked by inner products of the original vectors in doubles.

Reach.  Reaches and the wider radius are learned on the sample: reaches rise, one table after another, until the share ``HELD`` of
sampled neighbours is found.  In a larger table neighbours are nearer, so this errs to the safe side.  For a query and block that
give fewer candidates than neighbours are asked for (or than the block has), reach and radius widen until they do.

Queries.  They are a stated set that meets every block, in blocks.  Equal vectors are one entry with its smallest
ids, as many as a query can return, so thousands of copies neither fill a table nor repeat a search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenledger.llm.common import bound_batches, fresh, materialise

TABLES, WIDTH = 32, 16
#: Vectors in a block: this share of all, between the two bounds.
BLOCK, BLOCK_SHARE, BLOCK_MOST = 8192, 64, 1 << 17
SAMPLE = 4000
#: Share of sampled nearest neighbours that probing must find, and that the wider radius must hold.
HELD, HELD_FAR = 0.95, 0.995
#: Queries probed at once.
TOGETHER = 64

_BY_ONES = np.argsort(np.bitwise_count(np.arange(1 << WIDTH)), kind="stable").astype(np.uint16)
_UP_TO = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << WIDTH))))


def masks(reach: int) -> np.ndarray:
    """All substrings of at most ``reach`` ones."""
    return _BY_ONES[: _UP_TO[min(reach, WIDTH)]]


@dataclass
class Coder:
    largest: float
    turns: np.ndarray  # (turns, d + 1, d + 1)
    reach: np.ndarray  # of each table
    radius: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        """Codes of base vectors: (n, TABLES) substrings."""
        return self._signs(lift(x, self.largest))

    def query_bits(self, q: np.ndarray) -> np.ndarray:
        unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) * self.largest
        return self._signs(np.concatenate([unit, np.zeros((len(q), 1))], axis=1))

    def _signs(self, x: np.ndarray) -> np.ndarray:
        bits = np.concatenate([(x @ r) > 0 for r in self.turns], axis=1)[:, : TABLES * WIDTH]
        return np.packbits(bits, axis=1).view(np.uint16)


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """One coordinate more, so that all have norm ``largest`` (longer vectors keep theirs)."""
    extra = np.sqrt(np.maximum(largest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, extra[:, None]], axis=1)


def learn(sample: np.ndarray, neighbours: int, seed: int = 2) -> Coder:
    """Rotations by iterative quantisation, reaches and radius, from sampled vectors (each row one vector)."""
    rng = np.random.default_rng(seed)
    x = np.asarray(sample, np.float64)
    largest = float(np.sqrt((x * x).sum(axis=1)).max()) * 1.0001
    wide = lift(x, largest)
    turns = []
    for _ in range(-(-TABLES * WIDTH // wide.shape[1])):
        r, _ = np.linalg.qr(rng.normal(size=(wide.shape[1], wide.shape[1])))
        for _ in range(15):
            signs = np.where(wide @ r > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(wide.T @ signs)
            r = u @ vt
        turns.append(r)
    coder = Coder(largest, np.array(turns), np.zeros(TABLES, np.int64), TABLES * WIDTH)
    pick = rng.permutation(len(x))[:200]
    score = x[pick] @ x.T
    score[np.arange(len(pick)), pick] = -np.inf
    k = min(neighbours, len(x) - 1)
    if k < 1:
        return coder
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    apart = np.bitwise_count(coder.bits(x)[near] ^ coder.query_bits(x[pick])[:, None, :]).reshape(-1, TABLES)
    coder.radius = int(np.ceil(np.quantile(apart.sum(axis=1, dtype=np.int64), HELD_FAR)))
    for step in range(TABLES * WIDTH):
        if (apart <= coder.reach).any(axis=1).mean() >= HELD:
            break
        coder.reach[step % TABLES] += 1
    return coder


class Block:
    """The tables of one block."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.codes = codes
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes.T]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << WIDTH))]).astype(np.int32) for c in codes.T]

    def probed(self, asked: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """(queries, n): the codes of which a substring is within reach of the query's."""
        found = np.zeros((len(asked), self.n), bool)
        for j, (order, start) in enumerate(zip(self.order, self.start)):
            value = asked[:, j, None] ^ masks(int(reach[j]))[None, :]
            low = start[value].ravel()
            count = start[value.astype(np.int32) + 1].ravel() - low
            hit = np.flatnonzero(count)
            low, count = low[hit], count[hit]
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            found[np.repeat(hit // value.shape[1], count), order[at]] = True
        return found

    def near(self, code: np.ndarray, hit: np.ndarray, radius: int) -> np.ndarray:
        """Those of the codes found that are within the radius as a whole."""
        apart = np.bitwise_count(self.words[hit] ^ np.ascontiguousarray(code).view(np.uint64)).sum(axis=1, dtype=np.int32)
        return hit[apart <= radius]


def _best(block: Block, coder: Coder, x: np.ndarray, q: np.ndarray, neighbours: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its best candidates in the block (ties at the end included) and their scores."""
    codes = coder.query_bits(q)
    enough = min(neighbours, block.n)
    for at in range(0, len(q), TOGETHER):
        found = block.probed(codes[at : at + TOGETHER], coder.reach)
        for i in range(len(found)):
            hit = block.near(codes[at + i], np.flatnonzero(found[i]), coder.radius)
            reach, radius = coder.reach, coder.radius
            while len(hit) < enough:
                reach, radius = np.minimum(reach + 1, WIDTH), radius + WIDTH
                hit = block.near(codes[at + i], np.flatnonzero(block.probed(codes[at + i : at + i + 1], reach)[0]), radius)
            score = (x[hit] * q[at + i]).sum(axis=1)
            if len(hit) > neighbours:
                edge = np.partition(score, len(score) - neighbours)[len(score) - neighbours]
                top = np.flatnonzero(score >= edge)
                hit, score = hit[top], score[top]
            yield hit, score


def _search(coder: Coder, neighbours: int):
    """Rows of blocks in order, the base of each before its queries -> the best of each query in each block.

    A block's base is held, its queries stream past.
    """
    names = ["_q", "_v", "_score"]

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, x, vs = None, None, [], []
        for batch in batches:
            number = np.asarray(batch.column(0)) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
                if b == a:
                    continue
                part, of = batch.slice(a, b - a), int(number[a]) // 2
                if of != now:
                    now, block, x, vs = of, None, [], []
                if number[a] % 2 == 0:
                    x.append(matrix(part.column(3)))
                    vs += part.column(2).to_pylist()
                    continue
                if not vs:
                    continue
                if block is None:
                    x = np.concatenate(x)
                    block = Block(coder.bits(x))
                out: list[list] = [[], [], []]
                for name, (hit, score) in zip(part.column(2).to_pylist(), _best(block, coder, x, matrix(part.column(3)), neighbours)):
                    out[0].append([name] * len(hit))
                    out[1].append([vs[k] for k in hit.tolist()])
                    out[2].append(score.tolist())
                flat = [[v for row in c for v in row] for c in out]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(flat, (pa.string(), pa.string(), pa.float64()))], names=names)

    return run


def _usable(x: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, neighbours: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of ``is_query`` its ``neighbours`` largest inner products among all other ids found: query_id, rank,
    vec_id, score; ties go to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids, nor vectors whose
    length isn't the table's commonest (the smaller on a tie).  Of rows that share an id and a vector one counts; an id
    with several vectors may be found, and ask, once for each.  A query with fewer candidates gets them all.
    """
    bound_batches(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("_id"),
        F.transform(F.col(vector_col), lambda v: v.cast("double")).alias("_x"),
        is_query.alias("_asks"),
    ).where(F.col("_id").isNotNull() & _usable(F.col("_x")))
    rows = rows.withColumn("_x", F.transform("_x", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v)))
    sizes = rows.groupBy(F.size("_x").alias("_d")).count().orderBy(F.desc("count"), "_d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("_x") == sizes[0]["_d"])
    # equal vectors are one entry, named by its smallest id; a hot vector folds in each task first
    digest = F.sha2(F.concat_ws(",", F.transform("_x", lambda v: v.cast("string"))).cast("binary"), 256)
    rows = materialise(rows.withColumn("_h", F.substring(digest, 1, 32)), "vectors")
    few = Window.partitionBy("_h").orderBy("_id")
    members = rows.select("_h", "_id").distinct().withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= neighbours + 1)
    members = members.groupBy("_h").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    asks = rows.where("_asks").groupBy("_h").agg(F.lit(True).alias("_asked"))
    named = members.join(asks, "_h", "left").select("_h", "_ids", F.col("_ids")[0].alias("_first"), "_asked")
    first = rows.select(F.col("_h").alias("_fh"), F.col("_id").alias("_fid"), "_x").join(
        named, (F.col("_fh") == F.col("_h")) & (F.col("_fid") == F.col("_first"))
    ).dropDuplicates(["_h"])
    entries = materialise(first.select(F.col("_h").alias("_v"), F.xxhash64("_h").alias("_z"), "_x", "_ids", F.coalesce("_asked", F.lit(False)).alias("_asked")), "entries")

    n = entries.count()
    asked = entries.where("_asked").count()
    sample = entries.orderBy("_v").limit(SAMPLE).select("_x").collect()  # SAMPLE vectors at most
    coder = learn(np.array([r["_x"] for r in sample]), neighbours)
    size = min(max(BLOCK, n // BLOCK_SHARE), BLOCK_MOST)
    blocks = max(1, -(-n // size)) if asked else 1
    # every vector in one block, every query in all of them
    base = entries.select(F.pmod("_z", F.lit(blocks)).cast("int").alias("_b"), F.lit(False).alias("_asks"), "_v", "_x")
    query = entries.where("_asked").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.lit(True).alias("_asks"), "_v", "_x")
    cells = base.unionByName(query).repartition(2 * blocks, "_b").sortWithinPartitions("_b", "_asks")
    found = cells.mapInArrow(_search(coder, neighbours + 1), "_q string, _v string, _score double")
    # each entry found stands for up to neighbours + 1 ids; more than that can't be returned
    found = materialise(found, "found")
    ids = entries.select(F.col("_v").alias("_w"), "_ids", F.element_at("_ids", 1).alias("_least"))
    best = Window.partitionBy("_q").orderBy(F.desc("_score"), "_least")
    ranked = found.join(ids, F.col("_v") == F.col("_w")).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= neighbours + 1)
    lists = ranked.groupBy("_q").agg(F.collect_list(F.struct("_score", "_ids")).alias("_found"))
    flat = F.flatten(F.transform("_found", lambda f: F.transform(f["_ids"], lambda i: F.struct((-f["_score"]).alias("s"), i.alias("id")))))
    lists = lists.select("_q", F.slice(F.array_sort(flat), 1, 2 * neighbours + 2).alias("_top"))
    who = rows.where("_asks").select("_id", "_h").distinct()
    out = who.join(lists, fresh(F.col("_h")) == fresh(F.col("_q")))
    out = out.select("_id", F.slice(F.filter("_top", lambda t: t["id"] != F.col("_id")), 1, neighbours).alias("_top"))
    return out.select("_id", F.posexplode("_top").alias("_p", "_t")).select(
        F.col("_id").alias("query_id"), (F.col("_p") + 1).cast("int").alias("rank"), F.col("_t.id").alias("vec_id"), (-F.col("_t.s")).alias("score")
    )
