"""Removal of repeated strings with a Burrows-Wheeler transform, exact and distributed.

What is wanted: every byte covered by a ``length``-byte string that also starts anywhere else.

1.  Texts are cut into content-defined segments (see ``segments``): runs of neighbouring strings under one key, where equal
    strings have equal keys.  Keys seen once hold nothing repeated.
2.  Equal segments under a key are one content with a count.  In a content that occurs twice all strings are repeated.
    What is left to decide are contents that occur once, next to others under their key.
3.  Contents of undecided keys are laid end to end, many keys to a task.  From the suffix array (prefix doubling up
    to ``length``) comes the Burrows-Wheeler transform, and backward extension finds the boundaries between suffixes by
    increasing common prefix, breadth first (Beller, Gog, Ohlebusch and Schnattinger 2013): the boundaries that a value
    l + 1 adds are those at l extended to the left by every character.  It stops at ``length``; suffixes with no
    boundary between them share that many bytes, and strings whose class weighs two or more are repeated.
4.  A key with more contents than one task should hold (``HEAVY`` bytes), such as that of a passage in thousands of different
    surroundings, is split: its contents are cut into segments once more by shorter grams, in the end by whole strings, whose
    keys have a few contents each.  Every part comes to the transform like any other key.
5.  Spans meet their texts in one join.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import batches_of, bound_batches, bytes_of, discard, fresh_long, materialise, utf8
from lumenledger.llm.segments import segments

BATCH = 1 << 18
HEAVY = 1 << 20
#: Grams by which heavy keys are split; after them come whole strings.
SPLITS = (24, 8)
#: Strings of a text that are cut into segments at once.
STRETCH = 1 << 20
#: Every so many positions of the transform the counts of all characters are kept.
SAMPLED = 4


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (prefix doubling); symbols are below 512."""
    n = len(symbols)
    h = 7
    wide = np.zeros(n + h, np.int64)
    wide[:n] = symbols
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key << 9 | wide[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        step = np.empty(n, bool)
        step[0] = False
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if h >= depth or step[1:].all():
            return order
        after = np.zeros(n, np.int64)
        if h < n:
            after[:-h] = rank[h:] + 1
        key = rank * (n + 1) + after
        h *= 2


def common_prefix_boundaries(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For sorted suffixes, where a suffix shares fewer than ``length`` symbols with the one before.

    Symbol 0 separates texts and is never extended over, so suffixes that reach a separator within ``length`` symbols are
    not told apart.
    """
    n = len(symbols)
    transform = symbols[order - 1]  # order 0 takes the last symbol, a separator
    sigma = int(symbols.max()) + 1
    counts = np.bincount(symbols, minlength=sigma)
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    # occurrences of each character before every SAMPLED-th position
    rows = n // SAMPLED + 1
    sampled = np.zeros((rows + 1, sigma), np.int32)
    np.add.at(sampled, (np.arange(n) // SAMPLED + 1, transform), 1)
    np.cumsum(sampled, axis=0, out=sampled)
    padded = np.concatenate([transform, np.zeros(SAMPLED, transform.dtype)])
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    now = np.unique(start)
    now = now[~found[now]]
    found[now] = True
    now = np.append(now, [0, n])
    for _ in range(1, length):
        if not len(now):
            break
        fresh = []
        for at in range(0, len(now), 1 << 15):
            b = now[at : at + (1 << 15)]
            base = b // SAMPLED
            rank = sampled[base]
            for r in range(SAMPLED - 1):
                more = np.flatnonzero(b % SAMPLED > r)
                rank[more, padded[base[more] * SAMPLED + r]] += 1
            to = (rank[:, 1:] + start[None, 1:]).ravel()
            to = to[~found[to]]
            to = np.unique(to)
            found[to] = True
            fresh.append(to)
        now = np.concatenate(fresh)
    return found[:n]


def repeated_starts(texts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each text the starts of strings whose class weighs at least two.

    A string weighs as much as its text.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    present = np.zeros(256, bool)
    present[raw] = True
    code = np.cumsum(present)
    symbols = np.zeros(int(first[-1]), np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(raw)) + owner
    symbols[place] = code[raw]
    order = suffix_order(symbols, length)
    boundary = common_prefix_boundaries(symbols, order, length)
    weight = np.zeros(len(symbols), np.int64)
    left = np.repeat(first[:-1] + lengths, lengths) - place
    valid = place[left >= length]
    weight[valid] = np.asarray(weights, np.int64)[owner[left >= length]]
    classes = np.cumsum(boundary) - 1
    total = np.bincount(classes, weights=weight[order])
    again = np.zeros(len(symbols), bool)
    again[order] = total[classes] >= 2
    again &= weight > 0
    return [np.flatnonzero(again[a : a + n]) for a, n in zip(first[:-1].tolist(), lengths.tolist())]


def _stretches(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts end to end as they are, or one long text in stretches that overlap by what a string needs; and where each begins."""
    if len(at) > 2 or len(raw) < STRETCH + length:
        yield raw, at, 0
        return
    for begin in range(0, len(raw) - length + 1, STRETCH):
        part = raw[begin : begin + STRETCH + length - 1]
        yield part, np.array([0, len(part)]), begin


def _emit_segments(length: int):
    """Rows (d1, d2, text, weight) -> segments; a repeated row is one of weight two."""
    names = ["_k", "_g", "_d1", "_d2", "_p", "_w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2):
            d1, d2, weight = (np.asarray(batch.column(j)) for j in (0, 1, 3))
            for raw, at, begin in _stretches(*bytes_of(batch.column(2)), length):
                s = segments(raw, at, length)
                place = (s["start"].astype(np.int64) + begin) << 20 | s["strings"].astype(np.int64) << 1 | s["twice"].astype(np.int64)
                text = s["text"].astype(np.int64)
                yield pa.record_batch([pa.array(x) for x in (s["key"].astype(np.int64), s["digest"].astype(np.int64), d1[text], d2[text], place, weight[text])], names=names)

    return run


def _split_segments(length: int, gram: int):
    """Contents of heavy keys -> their segments by another gram, with bytes."""
    names = ["_k", "_g", "_d1", "_d2", "_p", "_w", "_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 5, 1 << 16):
            raw, at = bytes_of(batch.column(5))
            w, d1, d2, shift = (np.asarray(batch.column(c)) for c in (1, 2, 3, 4))
            s = segments(raw, at, length, gram)
            text = s["text"].astype(np.int64)
            start, strings = s["start"].astype(np.int64), s["strings"].astype(np.int64)
            place = (start + shift[text]) << 20 | strings << 1 | s["twice"].astype(np.int64)
            own = [raw[a : a + n + length - 1].tobytes() for a, n in zip((at[text] + start).tolist(), strings.tolist())]
            yield pa.record_batch([*(pa.array(x) for x in (s["key"].astype(np.int64), s["digest"].astype(np.int64), d1[text], d2[text], place, w[text])), pa.array(own, pa.binary())], names=names)

    return run


def _emit_bytes(length: int):
    """Documents with the segments wanted of them -> the segments' bytes."""
    names = ["_k", "_w", "_heavy", "_d1", "_d2", "_s", "_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2):
            out: list[list] = [[] for _ in names]
            for d1, d2, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for w in wanted:
                    start, strings = w["p"] >> 20, w["p"] >> 1 & 0x7FFFF
                    for column, value in zip(out, (w["k"], w["w"], w["heavy"], d1, d2, start, text[start : start + strings + length - 1])):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


_SPANS = "_d1 long, _d2 long, _from long, _to long"


def _span_batch(rows: list[tuple[int, int, int, np.ndarray]], length: int) -> pa.RecordBatch:
    """(d1, d2, shift, starts) -> spans of runs of starts."""
    out: list[list[int]] = [[], [], [], []]
    for d1, d2, shift, starts in rows:
        if not len(starts):
            continue
        cut = np.flatnonzero(np.diff(starts) > length)
        lo, hi = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length
        out[0] += [d1] * len(lo)
        out[1] += [d2] * len(lo)
        out[2] += (lo + shift).tolist()
        out[3] += (hi + shift).tolist()
    return pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["_d1", "_d2", "_from", "_to"])


def _decide(length: int):
    """Segments sorted by key -> spans of the once-occurring ones that hold repeated strings."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        starts = repeated_starts([h[5] for h in held], [h[1] for h in held], length)
        return _span_batch([(h[2], h[3], h[4], s) for h, s in zip(held, starts) if h[1] == 1], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_k", "_w", "_d1", "_d2", "_s", "_b"))):
                if size >= BATCH and row[0] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                last = row[0]
                size += len(row[5]) + 1
        if held:
            yield solve(held)

    return run


def _repeated_keys(rows: DataFrame) -> DataFrame:
    """Segments under keys that hold something repeated, perhaps; _mixed: under several contents or in themselves."""
    keys = rows.groupBy("_k").agg(
        F.sum("_w").alias("_c"), F.min("_g").alias("_lo"), F.max("_g").alias("_hi"), F.max(F.col("_p").bitwiseAND(1)).alias("_t")
    )
    keys = keys.where("_c > 1 or _t = 1").select(fresh_long(F.col("_k")).alias("_j"), ((F.col("_lo") != F.col("_hi")) | (F.col("_t") == 1)).alias("_mixed"))
    return rows.join(keys, fresh_long(F.col("_k")) == F.col("_j")).drop("_j")


def _undecided(near: DataFrame, length: int, heavy: int | None) -> tuple[DataFrame, DataFrame]:
    """(segments all of whose strings are repeated, contents to be compared under their keys, _o a segment of each)."""
    mixed = near.where("_mixed")
    own = [c for c in ("_d1", "_d2", "_p", "_b") if c in near.columns]
    contents = mixed.groupBy("_k", "_g").agg(F.sum("_w").alias("_c"), F.min(F.struct(*own)).alias("_o"))
    contents = materialise(contents, "contents")
    often = contents.where("_c > 1").select(fresh_long(F.col("_k")).alias("_j"), fresh_long(F.col("_g")).alias("_i"))
    sure = near.where("not _mixed").unionByName(mixed.join(often, (fresh_long(F.col("_k")) == F.col("_j")) & (fresh_long(F.col("_g")) == F.col("_i")), "left_semi"))
    open_keys = contents.groupBy("_k").agg(F.count("*").alias("_n"), F.count(F.when(F.col("_c") == 1, 1)).alias("_single")).where("_single > 0")
    too_many = F.lit(False) if heavy is None else F.col("_n") * (length + 70) > heavy
    open_keys = open_keys.select(fresh_long(F.col("_k")).alias("_j"), too_many.alias("_heavy"))
    compare = contents.join(open_keys, fresh_long(F.col("_k")) == F.col("_j"))
    return sure, compare.select("_k", F.least(F.col("_c"), F.lit(2)).cast("int").alias("_w"), "_heavy", "_o")


def _sure_spans(sure: DataFrame, length: int) -> DataFrame:
    start = F.shiftright("_p", 20)
    return sure.select("_d1", "_d2", start.alias("_from"), (start + F.shiftright("_p", 1).bitwiseAND(0x7FFFF) + (length - 1)).alias("_to"))


def _once(slim: DataFrame) -> DataFrame:
    """Each content once, with weight _w: 2 if rows share it.  Only rows that repeat are moved, one a task and content."""
    again = slim.groupBy("_d1", "_d2").count().where("count > 1").select(fresh_long(F.col("_d1")).alias("_i"), fresh_long(F.col("_d2")).alias("_j"))
    again = materialise(again, "repeated")
    weighed = slim.withColumn("_w", F.lit(1))
    if not again.limit(1).count():
        return weighed
    on = (fresh_long(F.col("_d1")) == F.col("_i")) & (fresh_long(F.col("_d2")) == F.col("_j"))
    several = slim.join(again, on, "left_semi").dropDuplicates(["_d1", "_d2"]).withColumn("_w", F.lit(2))
    return weighed.join(again, on, "left_anti").unionByName(materialise(several, "once"))


def repeated_spans(slim: DataFrame, length: int = 200, heavy: int = HEAVY) -> DataFrame:
    """Spans (_d1, _d2, _from, _to) of repeated strings, not merged; ``slim``: _d1, _d2, _text (bytes).

    (_d1, _d2) names a row by its content; rows that share it are equal, have equal spans, and are one row of weight two from here on.
    """
    slim = _once(slim)
    rows = materialise(slim.mapInArrow(_emit_segments(length), "_k long, _g long, _d1 long, _d2 long, _p long, _w int"), "segments")
    near = materialise(_repeated_keys(rows), "near")
    discard(rows)
    sure, compare = _undecided(near, length, heavy)
    want = F.struct(F.col("_k").alias("k"), F.col("_w").alias("w"), F.col("_heavy").alias("heavy"), F.col("_o._p").alias("p"))
    lists = compare.select(F.col("_o._d1").alias("_d1"), F.col("_o._d2").alias("_d2"), want.alias("_want")).groupBy("_d1", "_d2").agg(F.collect_list("_want").alias("_wants"))
    lists = lists.select(fresh_long(F.col("_d1")).alias("_i"), fresh_long(F.col("_d2")).alias("_j"), "_wants")
    texts = slim.join(lists, (fresh_long(F.col("_d1")) == F.col("_i")) & (fresh_long(F.col("_d2")) == F.col("_j"))).select("_d1", "_d2", "_text", "_wants")
    pieces = materialise(texts.mapInArrow(_emit_bytes(length), "_k long, _w int, _heavy boolean, _d1 long, _d2 long, _s long, _b binary"), "pieces")
    near.sparkSession.sparkContext._jvm.System.gc()

    decide = lambda some: some.repartition("_k").sortWithinPartitions("_k").mapInArrow(_decide(length), _SPANS)
    spans = [_sure_spans(sure, length), decide(pieces.where("not _heavy"))]
    much = pieces.where("_heavy").select("_k", "_w", "_d1", "_d2", "_s", "_b")
    for gram in itertools.chain(SPLITS, [length]):
        if gram > length or not much.limit(1).count():
            continue
        parts = materialise(much.mapInArrow(_split_segments(length, gram), "_k long, _g long, _d1 long, _d2 long, _p long, _w int, _b binary"), "parts")
        sure, compare = _undecided(_repeated_keys(parts), length, heavy if gram < length else None)
        compare = materialise(compare.select("_k", "_w", "_heavy", "_o._d1", "_o._d2", F.shiftright("_o._p", 20).alias("_s"), "_o._b"), "split")
        # strings of contents that weigh two are repeated already
        spans += [_sure_spans(sure.where("_w = 1"), length), decide(compare.where("not _heavy"))]
        much = compare.where("_heavy").drop("_heavy")
    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    found = materialise(found, "spans")
    discard(pieces)
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 200, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row a row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans, and with ``with_bytes`` the bytes kept.

    Every byte covered by a ``length``-byte string that also starts anywhere else, in this or another row, goes; strings are
    judged on the input.  A null text is an empty one.  Ids may be null and may repeat: every row is a text of its own, so
    repeated rows remove each other's strings.  Texts shorter than ``length`` bytes keep all.  Bytes kept needn't be
    valid UTF-8.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_d1"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_d2"), utf8(F.col(text_col)).alias("_text"))
    spans = repeated_spans(slim.select("_d1", "_d2", "_text"), length, heavy)
    lists = spans.groupBy("_d1", "_d2").agg(F.collect_set(F.struct(F.col("_from").alias("start"), F.col("_to").alias("end"))).alias("_spans"))
    lists = lists.select(fresh_long(F.col("_d1")).alias("_i"), fresh_long(F.col("_d2")).alias("_j"), "_spans")
    joined = slim.join(lists, (fresh_long(F.col("_d1")) == F.col("_i")) & (fresh_long(F.col("_d2")) == F.col("_j")), "left").select("_id", "_text", "_spans")
    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for id_, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                runs = merged([(s["start"], s["end"]) for s in found or []])
                edges = [0, *(e for r in runs for e in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else text
                row = (id_, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs], kept if with_bytes else None)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pair, pa.binary()][: 6 + with_bytes]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 6 + with_bytes])

    return joined.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
