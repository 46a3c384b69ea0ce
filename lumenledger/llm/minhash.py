"""MinHash near-dedup by fast similarity sketching.

Sketch (Dahlgaard, Knudsen and Thorup 2017).  A sketch has ``SIZE`` coordinates.  In round i every shingle of a set throws a
hashed value in [i, i+1) into a hashed coordinate; a coordinate keeps its minimum.  After ``SIZE`` such rounds, in further
rounds all shingles aim at one coordinate after the other, so every coordinate fills.  Rounds stop once all are
filled: a set of n shingles costs about max(n, SIZE log SIZE) steps instead of n * SIZE, and equal coordinates estimate
the Jaccard similarity with concentration bounds as for independent MinHash.

Linking.
1.  Each document becomes (id, set size, class, band keys); the class is a 128-bit digest of its set, so copies of any number
    are one numbered node from here on, with or without ids.
2.  Classes that share a band key are candidates.  Buckets aren't expanded into pairs: each class points to the smallest of
    its bucket, and the components of these pointers are the candidate groups.
3.  A group is dealt into blocks of about ``BLOCK`` bytes of text.  In a block all sets are compared exactly, by counting along an
    index from shingle to texts, and the texts come out with the smallest of their component in the block.
4.  Groups of several blocks go on: a few texts of each component found so far are dealt and compared anew, so that what
    belongs together joins across blocks.  Then their texts go back to their buckets.  A bucket of one component is done; in the others
    every text outside the bucket's largest component is compared with all texts of other components, block by block.  So every
    pair that shares a band key is linked, known to be linked through others, or known to be below the threshold, and a
    group that single hits have chained together costs what its buckets cost.

A pair at similarity 0.8 shares no band key with probability (1 - 0.8**5)**32 = 3e-6; all that follows is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenledger.llm.common import batches_of, bound_batches, bytes_of, fresh, fresh_long, materialise, mix64, release, row_key, utf8
from lumenledger.llm.graph import components
from lumenledger.llm.shingles import shingles, words

BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
#: Bytes of text in a block, and texts of a component that stand for it when blocks are joined.
BLOCK = 512 << 10
STAND_INS = 16

_SEEDS = mix64(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def sketch(items: np.ndarray) -> np.ndarray:
    """The coordinates (SIZE 64-bit words) of a non-empty set of distinct 64-bit hashes."""
    n = len(items)
    out = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 2048 // n)
    for at in range(0, SIZE, step):
        rounds = np.arange(at, min(SIZE, at + step))
        x = mix64(items[None, :] ^ _SEEDS[rounds][:, None])
        value = (x >> np.uint64(10)) | (rounds.astype(np.uint64) << np.uint64(54))[:, None]
        np.minimum.at(out, (x % np.uint64(SIZE)).astype(np.int64).ravel(), value.ravel())
        # rounds of this step that came after the last one needed gave only larger values to filled coordinates
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for i in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[i] = (mix64(items ^ _SEEDS[SIZE + i]) >> np.uint64(10)).min() | (np.uint64(511) << np.uint64(54))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    rows = coordinates.reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        acc = mix64(acc ^ rows[:, j]) + np.uint64(j)
    return acc


def sets_of(raw: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _, _, hashes, first = words(raw, at)
    found, start = shingles(hashes, first, k)
    return [np.unique(found[a:b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def _sketch_rows(k: int):
    names = ["_id", "_hash", "_key", "_n", "_class", "_bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1):
            n, classes, bands = [], [], []
            for items in sets_of(*bytes_of(batch.column(1)), k):
                n.append(len(items))
                if not len(items):
                    classes.append(None)
                    bands.append(None)
                    continue
                classes.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                bands.append(band_keys(sketch(items)).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(bands, pa.binary())], names=names)

    return run


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, _ = bytes_of(batch.column(1))
        nodes = np.repeat(np.asarray(batch.column(0)), BANDS)
        yield pa.record_batch([pa.array(raw.view(np.int64)), pa.array(nodes)], names=["_k", "_node"])


class _Index:
    """Shingles of some sets, each with the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def linked(self, items: np.ndarray, percent: int) -> np.ndarray:
        """The sets whose similarity to ``items`` is at least ``percent``."""
        low, high = np.searchsorted(self.flat, items), np.searchsorted(self.flat, items, side="right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(items) - both))


class _Forest:
    """Smallest members of joined nodes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches in runs that agree in the first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:keys] != held[-1][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return sets_of(np.frombuffer(b"".join(texts), np.uint8), at, k)


def _pairs_batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=["node", "root"])


def _within(k: int, percent: int):
    """Blocks (group, block, node, text) -> (node, root) for every node: all pairs of a block are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for block in _runs(batches, 2):
            forest = _Forest()
            sets = _sets([r[3] for r in block], k)
            index = _Index(sets)
            for row, items in zip(block, sets):
                for other in index.linked(items, percent).tolist():
                    forest.join(row[2], block[other][2])
            out += [(node, forest.root(node)) for node in sorted({r[2] for r in block})]
            if len(out) > 20_000:
                yield _pairs_batch(out)
                out = []
        yield _pairs_batch(out)

    return run


def _across(k: int, percent: int):
    """Cells (group, block, stray block, stray, node, root, text) -> one link a stray and component that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, 3):
            strays, members = [r for r in cell if r[3]], [r for r in cell if not r[3]]
            if not strays or not members:
                continue
            index = _Index(_sets([r[6] for r in members], k))
            roots = np.array([r[5] for r in members])
            out = []
            for stray, items in zip(strays, _sets([r[6] for r in strays], k)):
                found = index.linked(items, percent)
                found = found[roots[found] != stray[5]]
                _, one = np.unique(roots[found], return_index=True)
                out += [(stray[4], members[j][4]) for j in found[one].tolist()]
            yield _pairs_batch(out)

    return run


def _compared(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) after comparing the blocks of ``members`` (_q, _b, _node); texts: _node, _text."""
    shown = members.select("_q", "_b", fresh_long(F.col("_node")).alias("_j")).join(texts, F.col("_j") == fresh_long(F.col("_node")))
    blocks = shown.select("_q", "_b", "_node", "_text").repartition("_q", "_b").sortWithinPartitions("_q", "_b")
    return materialise(blocks.mapInArrow(_within(k, percent), "node long, root long"), "linked")


def _dealt(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (_q, _node, _w) with a block _b of about BLOCK bytes of their group, and the number of its blocks _m."""
    size = rows.groupBy("_q").agg(F.ceil(F.sum("_w") / BLOCK).cast("long").alias("_m")).select(fresh_long(F.col("_q")).alias("_j"), "_m")
    return rows.join(size, fresh_long(F.col("_q")) == F.col("_j")).withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "_node"), F.col("_m"))).drop("_j")


def _label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with _node and the root of their component, _root."""
    named = labels.select(fresh_long(F.col("node")).alias("_l"), F.col("root").alias("_root"))
    return rows.join(named, fresh_long(F.col("_node")) == F.col("_l"), "left").withColumn("_root", F.coalesce("_root", "_node")).drop("_l")


def _join_blocks(many: DataFrame, edges: DataFrame, texts: DataFrame, bands: DataFrame, k: int, percent: int) -> DataFrame:
    """Links across the blocks of groups that have several; ``many``: _q, _node, _w; ``bands``: _k, _node."""
    few = Window.partitionBy("_root").orderBy(F.xxhash64("_node"))
    marked = materialise(_label(many, edges), "marked")
    stand_ins = marked.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= STAND_INS).select("_q", "_node", "_w")
    more = _compared(materialise(_dealt(stand_ins, 2), "stand_ins"), texts, k, percent)
    labels = components(edges.unionByName(more).select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "root")

    # from here on by bucket: only texts that share a band key can be near, and most buckets are of one component by now
    named = _label(marked.select("_node", "_w"), labels).select(fresh_long(F.col("_node")).alias("_l"), "_w", "_root")
    held = bands.join(named, fresh_long(F.col("_node")) == F.col("_l")).select(F.col("_k").alias("_q"), "_node", "_w", "_root")
    held = materialise(held, "buckets")
    mixed = held.groupBy("_q").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).where("_lo != _hi").select(fresh_long(F.col("_q")).alias("_j"))
    held = materialise(held.join(mixed, fresh_long(F.col("_q")) == F.col("_j"), "left_semi"), "mixed")
    sizes = held.groupBy("_q", "_root").agg(F.sum("_w").alias("_n"))
    largest = sizes.groupBy("_q").agg(F.max(F.struct("_n", "_root"))["_root"].alias("_main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    largest = largest.select(
        fresh_long(F.col("_q")).alias("_i"), "_main", F.ceil((F.col("_all") - F.col("_most")) / BLOCK).cast("long").alias("_s")
    )
    open_rows = materialise(_dealt(held, 4).join(largest, fresh_long(F.col("_q")) == F.col("_i")).drop("_i"), "open")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    members = open_rows.select("_q", "_b", every(F.col("_s")).alias("_sb"), F.lit(False).alias("_stray"), "_node", "_root")
    strays = open_rows.where("_root != _main").withColumn("_sb", F.pmod(F.xxhash64(F.lit(3), "_node"), F.col("_s")))
    strays = strays.select("_q", every(F.col("_m")).alias("_b"), "_sb", F.lit(True).alias("_stray"), "_node", "_root")
    cells = strays.unionByName(members)
    shown = cells.withColumnRenamed("_node", "_node_").join(texts, fresh_long(F.col("_node_")) == fresh_long(F.col("_node")))
    shown = shown.select("_q", "_b", "_sb", "_stray", "_node", "_root", "_text").repartition("_q", "_b", "_sb").sortWithinPartitions("_q", "_b", "_sb")
    last = materialise(shown.mapInArrow(_across(k, percent), "node long, root long"), "across")
    release(marked, held, open_rows)
    return more.unionByName(last)


def _same_id(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that has several: each to the smallest of them."""
    several = entries.where("_id is not null").groupBy("_id").agg(F.min("_class").alias("_lo"), F.max("_class").alias("_hi")).where("_lo != _hi")
    rows = entries.select("_id", "_class").join(several.select(F.col("_id").alias("_want")), F.col("_id") == F.col("_want"), "left_semi").distinct()
    named = classes.select(fresh(F.hex("_class")).alias("_j"), "_node")
    rows = rows.join(named, fresh(F.hex("_class")) == F.col("_j")).select("_id", "_node")
    hubs = rows.groupBy(fresh_long(F.col("_id")).alias("_k")).agg(F.min("_node").alias("_hub"))
    return rows.join(hubs, fresh_long(F.col("_id")) == F.col("_k")).where("_node != _hub").select(F.col("_hub").alias("a"), F.col("_node").alias("b"))


#: Stands for a null id where rows are found by id and hash of their text.
_NO_ID = -(2**63)


def _texts_of(groups: DataFrame, classes: DataFrame, slim: DataFrame) -> DataFrame:
    """The text of each node of ``groups`` (_node), one row a node: that of the row which stands for its class."""
    want = groups.select(fresh_long(F.col("_node")).alias("_l")).join(classes, fresh_long(F.col("_node")) == F.col("_l"))
    want = materialise(want.select("_node", F.coalesce("_rep._id", F.lit(_NO_ID)).alias("_i"), F.col("_rep._hash").alias("_h"), F.col("_rep._m").alias("_m")), "wanted")
    # ids first: a narrow table, so that the other texts don't move where it is small
    ids = materialise(want.select(F.col("_i").alias("_w")).distinct(), "ids")
    slim = slim.join(ids, F.coalesce("_id", F.lit(_NO_ID)) == F.col("_w"), "left_semi")
    on = (F.coalesce("_id", F.lit(_NO_ID)) == F.col("_i")) & (F.col("_hash") == F.col("_h"))
    texts = slim.join(want.where("_m = 1"), on).select("_node", "_text")
    again = want.where("_m > 1")
    if again.limit(1).count():
        # repeated rows: one a task, then one in all
        texts = texts.unionByName(slim.join(again, on).select("_node", "_text").dropDuplicates(["_node"]))
    texts = materialise(texts.select("_node", "_text", F.octet_length("_text").alias("_bytes")), "texts")
    release(want, ids)
    return texts


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their sets of ``k``-word shingles.

    One row a row of ``docs``: id, n_shingles, component_id (smallest id reachable), kept (it is the smallest), and
    with ``with_key`` the ``row_key`` of the row as _key.

    Null, empty and blank texts have empty sets and link with nothing.  Rows that share an id are one document: they have the
    same component and are kept alike.  Rows with a null id link like any other and aren't kept beside an id; in a component without any id
    the component is null and one text of it is kept, with the rows that repeat it.  Empty tables give empty results.
    """
    bound_batches(docs.sparkSession)
    name = row_key(F.col(id_col), F.col(text_col)) if with_key else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), utf8(F.col(text_col)).alias("_text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_hash"), name.alias("_key"))
    rows = materialise(slim.mapInArrow(_sketch_rows(k), "_id long, _hash long, _key string, _n long, _class binary, _bands binary"), "sketches")
    full = rows.where("_class is not null")
    entries = materialise(full.groupBy("_class", "_id", "_hash").agg(F.count("*").alias("_m")), "entries")
    # a class is a node from here on, numbered as it is written
    classes = entries.groupBy("_class").agg(F.min("_id").alias("_least"), F.min(F.struct("_id", "_hash", "_m")).alias("_rep"))
    classes = materialise(classes.withColumn("_node", F.monotonically_increasing_id()), "classes")

    key = fresh(F.hex("_class"))
    one = full.groupBy("_class").agg(F.first("_bands").alias("_bands"))
    stand = one.join(classes.select(key.alias("_j"), "_node"), key == F.col("_j")).select("_node", "_bands")
    bands = materialise(stand.mapInArrow(_explode_bands, "_k long, _node long"), "bands")
    least = bands.groupBy("_k").agg(F.min("_node").alias("_c"), F.max("_node").alias("_top")).where("_c != _top")
    least = least.select(fresh_long(F.col("_k")).alias("_j"), "_c")
    pointers = bands.join(least, fresh_long(F.col("_k")) == F.col("_j")).where("_node != _c").select(F.col("_node").alias("a"), F.col("_c").alias("b"))
    found = components(pointers)
    groups = found.select(F.col("root").alias("_q"), F.col("node").alias("_node"))

    texts = _texts_of(groups, classes, slim)
    weights = texts.select(fresh_long(F.col("_node")).alias("_n"), F.col("_bytes").alias("_w"))
    members = groups.join(weights, fresh_long(F.col("_node")) == F.col("_n")).select("_q", "_node", "_w")
    members = materialise(_dealt(members, 1), "members")
    edges = _compared(members, texts.drop("_bytes"), k, percent)
    many = members.where("_m > 1")
    links = edges
    if many.limit(1).count():
        links = links.unionByName(_join_blocks(many.select("_q", "_node", "_w"), edges, texts.drop("_bytes"), bands, k, percent))
    links = links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_same_id(entries, classes))
    labels = components(links)
    release(found, members, texts, edges, bands)

    root = labels.select(fresh_long(F.col("node")).alias("_l"), F.col("root").alias("_root"))
    named = classes.join(root, fresh_long(F.col("_node")) == F.col("_l"), "left").select("_class", "_node", "_least", "_rep", F.coalesce("_root", "_node").alias("_root"))
    named = materialise(named, "named")
    least = named.groupBy("_root").agg(F.min("_least").alias("_component")).select(fresh_long(F.col("_root")).alias("_r"), "_component")
    # where there is no id, the text that stands for the root is the one to keep
    alone = F.when(F.col("_component").isNull() & (F.col("_node") == F.col("_root")), F.col("_rep._hash"))
    named = named.join(least, fresh_long(F.col("_root")) == F.col("_r")).select(key.alias("_j"), "_component", alone.alias("_alone"))
    out = rows.select("_id", "_hash", "_key", "_n", "_class").join(named, key == F.col("_j"), "left")
    component = F.when(F.col("_class").isNull(), F.col("_id")).otherwise(F.col("_component"))
    kept = F.when(F.col("_class").isNull(), True).when(F.col("_component").isNull(), F.col("_alone").eqNullSafe(F.col("_hash"))).otherwise(F.col("_id").eqNullSafe(F.col("_component")))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), *(["_key"] if with_key else []))
