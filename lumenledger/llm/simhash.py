"""SimHash near-dedup with pigeonring filtering (Qin and Xiao 2018).

A fingerprint is the bitwise majority of the hashes of a text's word shingles.  Two fingerprints link at ``RADIUS`` = 3 or fewer
differing bits.

Filter.  Cut 64 bits into a ring of four segments.  If two fingerprints differ in at most 3 bits, then by the strong form of the
pigeonring principle some segment starts a chain in which the first l segments differ in at most l * 3/4 bits, for every l: none in
the first segment, at most one in the first two, two in three, three in all.  The chain of two is found by an exchange: each
fingerprint goes, for every start, to the key of its own two segments (32 bits) as a member, and as a guest to those keys that
set one zero bit of its second segment.  Of two fingerprints that differ in one such bit, one has the zero, so they meet once.  In a key
the chain of three prunes, and what is left is compared in full.  Distinct fingerprints are 36 rows each, whatever the corpus.

Keys of many.  Keys with over ``CROWD`` members, and their guests' keys, are split by the same principle applied to the 32 bits that the
key leaves open: four segments of 8 bits, one equal and the next within one bit.  That leaves 16 bits, so a split key holds at most
65,536 fingerprints of members, and of guests sixteen times as many, whatever the data.

No pairs are emitted: a key gives each fingerprint one edge to the first of those it is joined with there, and guests one to each such
group they link with.  Components of the edges are the classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import batches_of, bound_batches, fresh_long, materialise, release, utf8
from lumenledger.llm.graph import components

RADIUS = 3
SEED = 42
#: Members of a key above which it is split.
CROWD = 2048
#: Bytes of a text that are cut into words at a time.
STRETCH = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def _ones(values: np.ndarray) -> np.ndarray:
    """How many of 64-bit words have each bit set, from the lowest."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(values), 255 * 256):
        part = values[at : at + 255 * 256]
        padded = np.zeros(-(-len(part) // 255) * 255, _U)
        padded[: len(part)] = part
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 255, 8), axis=2, bitorder="little")
        out += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every run of k words joined by spaces."""
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    spans = zip((end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(SEED)), _U, len(words) - k + 1)


def fingerprint(text: bytes, k: int = 3) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned integer."""
    ones, n = np.zeros(64, np.int64), 0
    held: list[bytes] = []
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = cut.start() if cut else len(text)
        held += text[at:end].translate(_LOWER).split()
        at = end
        if len(held) >= k:
            found = _hashes(held, k)
            ones += _ones(found)
            n += len(found)
            held = held[len(held) - k + 1 :] if k > 1 else []
    if not n:
        if not held:
            return 0
        found = _hashes(held, len(held))
        ones, n = _ones(found), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _mark(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1):
            found = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], _U)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["_id", "_fp"])

    return run


def _chains(words: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Keys of chains of two ring segments of ``width`` bits: (keys, None) of members, (keys, rows they are of) of guests."""
    n, mask = 4, _U((1 << width) - 1)
    segment = [words >> _U(width * j) & mask for j in range(n)]
    for i in range(n):
        head = _U(i) << _U(2 * width) | segment[i] << _U(width)
        last = segment[(i + 1) % n]
        yield head | last, None
        for bit in range(width):
            rows = np.flatnonzero(last >> _U(bit) & _U(1) == 0)
            yield head[rows] | last[rows] | _U(1 << bit), rows


def _to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints -> (key, guest, fingerprint)."""
    for batch in batches:
        words = np.asarray(batch.column(0)).view(_U)
        for keys, rows in _chains(words, 16):
            them = words if rows is None else words[rows]
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), rows is not None)), pa.array(them.view(np.int64))], names=["_k", "_guest", "_fp"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, guest, fingerprint, crowded) -> the same with a part: -1, or in crowded keys one a chain of the open bits."""
    names = ["_k", "_part", "_guest", "_fp"]
    for batch in batches:
        keys, guest, words, crowd = (np.asarray(batch.column(j)) for j in (0, 1, 2, 3))
        calm = ~crowd
        if calm.any():
            yield pa.record_batch([pa.array(keys[calm]), pa.array(np.full(calm.sum(), -1, np.int64)), pa.array(guest[calm]), pa.array(words[calm])], names=names)
        if crowd.any():
            keys, guest, words = keys[crowd], guest[crowd], words[crowd].view(_U)
            first = (keys >> 32).astype(_U)
            # the two segments after those of the key
            turn = (_U(16) * ((first + _U(2)) % _U(4))).astype(_U)
            turned = np.where(turn == 0, words, words >> turn | words << (_U(64) - turn) % _U(64))
            for parts, rows in _chains(turned & _U((1 << 32) - 1), 8):
                late = np.full(len(parts), rows is not None)
                rows = np.arange(len(words)) if rows is None else rows
                yield pa.record_batch([pa.array(keys[rows]), pa.array(parts.view(np.int64)), pa.array(late), pa.array(words[rows].view(np.int64))], names=names)


class _Key:
    """The members of one key, and the groups that links make of them."""

    def __init__(self, start: int, members: np.ndarray):
        self.three = _U(0)
        for j in range(3):
            self.three |= _U(0xFFFF) << _U(16 * ((start + j) % 4))
        self.members = members
        self.root = np.arange(len(members))
        for i in range(len(members) - 1):
            near = i + 1 + self.linked(members[i], members[i + 1 :])
            if near.size:
                joined = np.unique(self.root[np.append(near, i)])
                if len(joined) > 1:
                    self.root[np.isin(self.root, joined)] = joined[0]

    def linked(self, one: np.uint64, others: np.ndarray) -> np.ndarray:
        """Places of others within the radius: by the chain of three, then in full."""
        differ = others ^ one
        live = np.flatnonzero(np.bitwise_count(differ & self.three) <= 3 * RADIUS // 4)
        return live[np.bitwise_count(differ[live]) <= RADIUS]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        rest = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.members[rest], self.members[self.root[rest]]

    def edges_of(self, guests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for guest in guests:
            tops = np.unique(self.root[self.linked(guest, self.members)])
            if tops.size:
                yield np.full(len(tops), guest), self.members[tops]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, part, guest) -> edges.  Members of a key are held, guests stream past them."""
    held: list[np.ndarray] = []
    key: _Key | None = None
    last: tuple[int, int] | None = None

    def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        both = [np.concatenate([f[j] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for j in range(2)]
        return pa.record_batch([pa.array(x) for x in both], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, part, guest = (np.asarray(batch.column(j)) for j in range(3))
        words = np.asarray(batch.column(3)).view(_U)
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (part[1:] != part[:-1])) + 1
        found = []
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(k)).tolist()):
            at = (int(k[a]), int(part[a]))
            if at != last:
                if len(held) and key is None and sum(map(len, held)) > 1:
                    found.append(_Key(last[0] >> 32, np.concatenate(held)).edges())
                held, key, last = [], None, at
            members, guests = words[a:b][~guest[a:b]], words[a:b][guest[a:b]]
            if members.size:
                held.append(members)
            if guests.size and held:
                if key is None:
                    key = _Key(at[0] >> 32, np.concatenate(held))
                    found.append(key.edges())
                found += key.edges_of(guests)
        yield batch_of(found)
    if held and key is None and sum(map(len, held)) > 1:
        yield batch_of([_Key(last[0] >> 32, np.concatenate(held)).edges()])


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints (_fp) at RADIUS or fewer bits."""
    keyed = prints.select("_fp").mapInArrow(_to_keys, "_k long, _guest boolean, _fp long")
    own = F.array(*[_own_key(i) for i in range(4)])
    full = materialise(prints.select(F.explode(own).alias("_k")).groupBy("_k").count().where(F.col("count") > crowd).select("_k"), "crowded")
    if full.limit(1).count():
        # the key itself, and those that its members are guests of
        bits = F.array(*[F.col("_k").bitwiseOR(1 << j) for j in range(16)])
        wide = full.select(F.explode(F.concat(F.array("_k"), bits)).alias("_k")).distinct().select(fresh_long(F.col("_k")).alias("_j"))
        keyed = keyed.join(wide, fresh_long(F.col("_k")) == F.col("_j"), "left").select("_k", "_guest", "_fp", F.col("_j").isNotNull().alias("_crowd"))
        keyed = keyed.mapInArrow(_split, "_k long, _part long, _guest boolean, _fp long")
    else:
        keyed = keyed.select("_k", F.lit(-1).cast("long").alias("_part"), "_guest", "_fp")
    dealt = keyed.repartition("_k", "_part").sortWithinPartitions("_k", "_part", "_guest")
    out = materialise(dealt.mapInArrow(_sweep, "a long, b long"), "simhash_links")
    release(full)
    return out


def _own_key(i: int):
    """The key of the chain of two that starts at segment i, as in ``_chains``."""
    segment = lambda j: F.shiftrightunsigned("_fp", 16 * j).bitwiseAND(0xFFFF)
    return F.lit(i << 32).bitwiseOR(F.shiftleft(segment(i), 16)).bitwiseOR(segment((i + 1) % 4))


def near_duplicates(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Fingerprint and class of every document: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null, empty and blank texts have the fingerprint zero and link like any other.  Rows with null ids are linked, too; the component of
    documents without any id is null.  Repeated rows and rows that share an id each give a row.  An empty table gives none.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), utf8(F.col(text_col)).alias("_text"))
    rows = materialise(slim.mapInArrow(_mark(k), "_id long, _fp long"), "fingerprints")
    prints = materialise(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct")
    edges = links(prints, crowd)
    labels = components(edges)
    up = labels.select(fresh_long(F.col("node")).alias("_j"), F.col("root").alias("_root"))
    named = prints.join(up, fresh_long(F.col("_fp")) == F.col("_j"), "left").select("_fp", "_least", F.coalesce("_root", "_fp").alias("_root"))
    named = materialise(named, "classes")
    first = named.groupBy("_root").agg(F.min("_least").alias("_component")).select(fresh_long(F.col("_root")).alias("_r"), "_component")
    named = named.join(first, fresh_long(F.col("_root")) == F.col("_r")).select(fresh_long(F.col("_fp")).alias("_j"), "_component")
    out = rows.join(named, fresh_long(F.col("_fp")) == F.col("_j"), "left")
    release(edges)
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
