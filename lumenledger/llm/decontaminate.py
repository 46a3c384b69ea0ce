"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, weighted-shingle similarity.

Every text is lower-cased and cut into words (letters, digits and all non-ASCII signs).  Its five-word shingles slide past
in windows as large as a benchmark item.  Shingles that no item has can't be shared, so the known ones in a window bound its similarity
to any item; windows whose bound is below the threshold go, which takes one table lookup a shingle and a difference of sums a window.

A window that is left is fingerprinted by SimHash, one sign a bit.  Fingerprints of items of that size are indexed in sixteen
blocks of sixteen bits with a reach each.  If two fingerprints differ in at most ``RADIUS`` bits, then by the pigeonhole
principle some block differs in no more than its reach (a block each beyond its reach would take more than RADIUS bits), so
looking up all values that near in every block finds all of them.  What is found within the radius is verified by the
weighted Jaccard similarity of the shingles, counted with their multiplicity.

At the similarity threshold a window differs from its item in 0.15 of the bits, 39 +- 6, so the radius misses none but by 5
standard deviations; an unrelated item is 128 +- 8 bits away.  That holds for distinct shingles only: one that repeats weighs on
all bits at once.  So where a window or an item of its size repeats shingles, the window is compared exactly with all items of
the size, by a table of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import batches_of, bound_batches, bytes_of, fresh_long, materialise, mix64, release, utf8
from lumenledger.llm.shingles import shingles, words

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 256, 16, 67
WIDTH = BITS // BLOCKS
#: The reach of each block: together RADIUS - BLOCKS + 1.
REACH = [(RADIUS - BLOCKS + 1) // BLOCKS + (b < (RADIUS - BLOCKS + 1) % BLOCKS) for b in range(BLOCKS)]
#: Items are held in slices of about this many bytes of text, a tenth or so of their index; several slices make a pass.
SLICE_BYTES = 4 << 20
SLICES_A_PASS = 4
#: Windows of a text that are fingerprinted at once start within so many shingles.
STRETCH = 2048
#: Pairs of windows and items of a size up to which blocks are compared side by side.
FEW_PAIRS = 4096

_MASKS = {r: np.flatnonzero(np.bitwise_count(np.arange(1 << WIDTH)) <= r).astype(np.uint16) for r in set(REACH)}

#: Separators: all ASCII bytes but letters and digits.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = [not chr(i).isalnum() for i in range(128)]


def _planes(items: np.ndarray) -> np.ndarray:
    """Signs (n, BITS) of hashed shingles."""
    seeds = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)
    raw = mix64(items[:, None] ^ seeds)
    return np.unpackbits(raw.view(np.uint8).reshape(-1, BITS // 8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints (n, BLOCKS) of sums of signs."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Blocks:
    """Fingerprints in tables by block: distinct values, and the fingerprints that have each."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for b in range(BLOCKS):
            order = np.argsort(prints[:, b], kind="stable").astype(np.int32)
            values, first, count = np.unique(prints[order, b], return_index=True, return_counts=True)
            self.tables.append((values, first, count, order))

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of asked, fingerprint) of which a block differs in no more than its reach."""
        if len(asked) * len(self.prints) <= FEW_PAIRS:  # the same pairs, without looking values up
            return np.nonzero((np.bitwise_count(asked[:, None] ^ self.prints[None]) <= np.array(REACH)).any(axis=2))
        found = []
        for b, (values, first, count, order) in enumerate(self.tables):
            by = np.argsort(asked[:, b], kind="stable")
            own, at, many = np.unique(asked[by, b], return_index=True, return_counts=True)
            masks = _MASKS[REACH[b]]
            if len(values) <= len(masks):  # fewer values than neighbours of one
                a, v = np.nonzero(np.bitwise_count(own[:, None] ^ values[None, :]) <= REACH[b])
            else:
                probe = own[:, None] ^ masks[None, :]
                v = np.minimum(np.searchsorted(values, probe), len(values) - 1)
                a, m = np.nonzero(values[v] == probe)
                v = v[a, m]
            rows = _spread(at[a], many[a])
            v = np.repeat(v, many[a])
            found.append(np.repeat(by[rows], count[v]).astype(np.int64) * len(self.prints) + order[_spread(first[v], count[v])])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def within(self, asked: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (row of asked, fingerprint, distance) within the radius."""
        w, i = self.candidates(asked)
        apart = np.bitwise_count(asked[w] ^ self.prints[i]).sum(axis=1, dtype=np.int64)
        near = apart <= radius
        return w[near], i[near], apart[near]


@dataclass
class Sized:
    """The items of one size, with the tables of their fingerprints."""

    width: int  # shingles in a window
    k: int  # words in a shingle
    which: np.ndarray  # places of the items
    blocks: Blocks
    repeats: bool  # an item has a shingle more than once
    posted: tuple[np.ndarray, np.ndarray, np.ndarray]  # shingles in order, for each the item (place in ``which``) and its count

    def shared(self, window: np.ndarray) -> np.ndarray:
        """For each item the shingles that it shares with a window, counted with their multiplicity."""
        values, n = np.unique(window, return_counts=True)
        posted, items, counts = self.posted
        low, high = np.searchsorted(posted, values), np.searchsorted(posted, values, side="right")
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(items[at], np.minimum(counts[at], np.repeat(n, many)), len(self.which)).astype(np.int64)


class Index:
    """All items of a benchmark slice, lower-cased."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        raw = [t.encode("utf-8", "surrogatepass") for _, t in items]
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        _, _, hashes, first = words(np.frombuffer(b"".join(raw), np.uint8), at, SEPARATORS)
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        by_size: dict[tuple[int, int], list[int]] = {}
        prints = np.zeros((len(items), BLOCKS), np.uint16)
        every: dict[int, list[np.ndarray]] = {}
        for j in range(len(items)):
            w = hashes[first[j] : first[j + 1]]
            k = min(SHINGLE, len(w))
            if not k:
                self.counts.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                continue
            s, _ = shingles(w, np.array([0, len(w)]), k)
            self.counts.append(np.unique(s, return_counts=True))
            prints[j] = _pack(_planes(s).sum(axis=0, keepdims=True, dtype=np.int32))[0]
            by_size.setdefault((len(s), k), []).append(j)
            every.setdefault(k, []).append(s)
        self.sizes: list[Sized] = []
        for (width, k), js in sorted(by_size.items()):
            own = [self.counts[j] for j in js]
            posted, items, counts = np.concatenate([v for v, _ in own]), np.repeat(np.arange(len(js)), [len(v) for v, _ in own]), np.concatenate([n for _, n in own])
            order = np.argsort(posted, kind="stable")
            self.sizes.append(Sized(width, k, np.array(js), Blocks(prints[js]), bool((counts > 1).any()), (posted[order], items[order].astype(np.int32), counts[order].astype(np.int32))))
        self.known = {k: np.unique(np.concatenate(v)) for k, v in every.items()}
        self.table = {}
        for k, v in self.known.items():
            t = np.zeros(1 << max(10, (16 * len(v)).bit_length()), bool)
            t[v & np.uint64(len(t) - 1)] = True
            self.table[k] = t

    def known_at(self, found: np.ndarray, k: int) -> np.ndarray:
        """Places of shingles that some item has."""
        maybe = np.flatnonzero(self.table[k][found & np.uint64(len(self.table[k]) - 1)])
        known = self.known[k]
        at = np.minimum(np.searchsorted(known, found[maybe]), len(known) - 1)
        return maybe[known[at] == found[maybe]]

    def similarity(self, window: np.ndarray, j: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        values, n = np.unique(window, return_counts=True)
        own, m = self.counts[j]
        _, a, b = np.intersect1d(values, own, assume_unique=True, return_indices=True)
        both = int(np.minimum(n[a], m[b]).sum())
        return both / (int(n.sum()) + int(m.sum()) - both)

    def search(self, found: np.ndarray, hits: np.ndarray, k: int) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the items that a text's shingles hold, the best window of each."""
        has = np.zeros(len(found) + 1, np.int64)
        has[hits + 1] = 1
        has = np.cumsum(has)
        # the windows that can reach the threshold
        asked: list[tuple[Sized, int, np.ndarray, np.ndarray]] = []
        for size in self.sizes:
            if size.k != k:
                continue
            width = min(size.width, len(found))
            shared = has[width:] - has[:-width]
            starts = np.flatnonzero(shared >= SIMILARITY * (size.width + width - shared) - 1e-9)
            if starts.size:
                asked.append((size, width, starts, shared[starts]))
        if not asked:
            return []
        # the place before at which the same shingle stands, -1 for none; and sums that tell equal windows
        order = np.argsort(found, kind="stable")
        same = found[order[1:]] == found[order[:-1]]
        last = np.full(len(found), -1, np.int64)
        last[order[1:][same]] = order[:-1][same]
        marks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(found), dtype=np.uint64)])
        out = []
        for size, width, starts, shared in asked:
            best: dict[int, tuple[float, int]] = {}
            for start in self.exact(size, starts, width, last, marks).tolist():
                both = size.shared(found[start : start + width])
                for x in np.flatnonzero(both >= SIMILARITY * (size.width + width - both) - 1e-9).tolist():
                    j, s = int(size.which[x]), int(both[x]) / (size.width + width - int(both[x]))
                    held = best.get(j, (0.0, 0))
                    if s >= SIMILARITY and (-s, start) < (-held[0], held[1]):
                        best[j] = (s, start)
            at = 0
            while at < len(starts):
                begin = starts[at]
                some = starts[at : np.searchsorted(starts, begin + STRETCH)] - begin
                sums = np.zeros((some[-1] + width + 1, BITS), np.int32)
                np.cumsum(_planes(found[begin : begin + some[-1] + width]), axis=0, out=sums[1:])
                w, i, apart = size.blocks.within(_pack(sums[some + width] - sums[some]))
                w += at
                at += len(some)
                most = shared[w] / (size.width + width - shared[w])
                for x in np.lexsort((w, apart)).tolist():
                    j, start = int(size.which[i[x]]), int(starts[w[x]])
                    held = best.get(j, (0.0, 0))
                    if held[0] == 1.0 and held[1] <= start or most[x] < held[0] - 1e-9:
                        continue
                    s = self.similarity(found[start : start + width], j)
                    if s >= SIMILARITY and (-s, start) < (-held[0], held[1]):
                        best[j] = (s, start)
            out += [(self.ids[j], s, start, width + k - 1) for j, (s, start) in best.items()]
        return out

    def exact(self, size: Sized, starts: np.ndarray, width: int, last: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Windows whose fingerprints can't be relied on, as they or items repeat shingles; the first of equal ones."""
        if not size.repeats and starts.size:
            # a window repeats a shingle if one of its places has an earlier one that is in the window too
            again = np.flatnonzero(last >= 0)
            edge = np.zeros(len(last) + 2, np.int64)
            low, high = np.maximum(again - width + 1, 0), last[again] + 1
            np.add.at(edge, low[low < high], 1)
            np.add.at(edge, high[low < high], -1)
            starts = starts[np.cumsum(edge)[starts] > 0]
        _, first = np.unique(marks[starts + width] - marks[starts], return_index=True)
        return np.sort(starts[first])

    def leaks(self, raw: np.ndarray, at: np.ndarray) -> list[list[tuple[int, float, int, int]]]:
        """For each lower-cased text the items found in it."""
        _, _, hashes, first = words(raw, at, SEPARATORS)
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in range(len(at) - 1)]
        for k in self.known:
            found, start = shingles(hashes, first, k)
            if k < SHINGLE:  # a text of fewer words than an item of k words holds no window of it
                short = np.repeat(np.diff(first) < k, np.diff(start))
                found = np.where(short, np.uint64(0), found)
            places = self.known_at(found, k)
            owner = np.searchsorted(start, places, side="right") - 1
            for d in np.unique(owner).tolist():
                out[d] += self.search(found[start[d] : start[d + 1]], places[owner == d] - start[d], k)
        return [sorted(x, key=lambda leak: (leak[0] is not None, leak)) for x in out]


LEAKS = "array<struct<item_id:bigint,similarity:double,start:bigint,n_words:bigint>>"


def _slices(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark in slices of bounded size, each collected when its turn comes."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where("t != ''").distinct()
    # lower-cased by Spark, as documents are
    items = items.select("i", F.lower("t").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // SLICE_BYTES)
    for s in range(n):
        rows = items.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == s).collect()
        yield Index(sorted(((r["i"], r["t"]) for r in rows), key=lambda r: (r[0] is not None, r)))


def _finder(held):
    def found(texts: pd.Series) -> pd.Series:
        result: list[list[dict]] = []
        for part in batches_of(iter([pa.record_batch([pa.array(texts, pa.string())], names=["t"])]), 0):
            for leaks in held.value.leaks(*bytes_of(part.column(0))):
                result.append([dict(zip(("item_id", "similarity", "start", "n_words"), x)) for x in leaks])
        return pd.Series(result, dtype=object)

    return found


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the benchmark items that each text holds: item_id, similarity, start, n_words.

    An item is held if a window of its size has a weighted similarity of 0.8 or more; of several, the most similar and then
    the first counts.  Items of fewer than five words are one shingle of all their words; empty ones are held by nothing.
    Null and empty texts hold nothing.  Equal items are all reported; an item with a null id is reported with a null id.  A
    text shorter than an item is one window.  With an empty benchmark the arrays are empty.

    SLICES_A_PASS slices of the benchmark are looked for in one pass over the texts.  Of a larger benchmark each pass keeps the leaks of the
    texts that have any, by a key of the text, and they meet the rows in one join at the end; texts are never written.
    """
    bound_batches(docs.sparkSession)
    none = F.expr(f"cast(array() as {LEAKS})")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def find(index: Index):
        # not deterministic, or the optimiser computes it once more for a filter on its result
        return F.pandas_udf(_finder(docs.sparkSession.sparkContext.broadcast(index)), LEAKS).asNondeterministic()(F.lower(text))

    passes: list[list[Index]] = []
    written = None
    for n, index in enumerate(_slices(benchmark, item_col, item_text_col)):
        if n and n % SLICES_A_PASS == 0:
            written = _keyed_leaks(docs, text, [find(x) for x in passes.pop()], n, written)
        if n % SLICES_A_PASS == 0:
            passes.append([])
        passes[-1].append(index)
    last = [find(x) for x in passes.pop()] if passes else []
    if written is None:
        return docs.withColumn(name, F.concat(none, *last))
    written = _keyed_leaks(docs, text, last, n + 1, written)
    leaks = written.groupBy("_a", "_b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_leaks"))), lambda x: x["_leaks"])).alias("_all"))
    leaks = materialise(leaks.select(fresh_long(F.col("_a")).alias("_i"), F.col("_b").alias("_j"), "_all"), "leaks")
    release(written)
    box = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(box, fresh_long(F.xxhash64(text)).alias("_a"), F.crc32(utf8(text)).alias("_b"))
    found = keyed.join(leaks, (F.col("_a") == F.col("_i")) & (F.col("_b") == F.col("_j")), "left").select("_row", F.coalesce("_all", none).alias("_all"))
    return found.select("_row.*", F.col("_all").alias(name))


def _keyed_leaks(docs: DataFrame, text, finds: list, number: int, before: DataFrame | None) -> DataFrame:
    """Key of a text, number of the pass, and what it found, beside what those before did; equal texts are one row."""
    found = docs.select(F.xxhash64(text).alias("_a"), F.crc32(utf8(text)).alias("_b"), F.concat(*finds).alias("_leaks")).where(F.size("_leaks") > 0)
    rows = found.dropDuplicates(["_a", "_b"]).withColumn("_n", F.lit(number))
    out = materialise(rows if before is None else rows.unionByName(before), "leaks")
    if before is not None:
        release(before)
    return out
