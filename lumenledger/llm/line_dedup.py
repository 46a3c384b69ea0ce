"""Line dedup over a whole corpus, returning keep bitmaps.

1.  Each document is split at \\n; a line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lowered.  Keys of
    at least ``min_chars`` code points become 128-bit hashes.
2.  One row a long line (hash, document, position) is range-partitioned by hash with document and position as the secondary sort,
    the largest document first.  Ranges are cut within a hash too, so a line that a third of all documents hold spreads over
    many partitions.
3.  One pass streams each partition.  The first occurrence of a hash names the document that keeps it; once enough documents
    are seen, all later ones stream out as drops.  The pass holds the few rows up to that point and nothing else.
4.  Only a partition's first and last hash may lie in other partitions too.  Their rows leave undecided, and a table of these
    hashes, two a partition, decides them.
5.  Drops are gathered by document into a compressed bitmap of the lines that it keeps.  Texts move once, when a caller
    applies bitmaps to them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import bound_batches, boxed, fresh, key_of_parts, materialise, row_key, utf8

#: Rows that the stream holds until enough documents are seen.
HELD = 10_000

#: The characters stripped at both ends of a line.
BLANKS = " \t\n\v\f\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(_LOWER)


def _hash(key: str) -> bytes:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _hashes(text: str | None, min_chars: int, seen: dict[str, bytes]) -> list[tuple[int, bytes]]:
    out = []
    for i, line in enumerate((text or "").split("\n")):
        if len(line) < min_chars:
            continue
        line = line.strip(BLANKS)
        if len(line) < min_chars:
            continue
        key = line.lower() if line.isascii() else line.translate(_LOWER)
        h = seen.get(key)
        if h is None:
            h = _hash(key)
            if len(seen) < 20_000 and len(key) < 500:
                seen[key] = h
        out.append((i, h))
    return out


def _emit_lines(min_chars: int):
    """Rows (hash, id, text's hash and checksum, position) of the long lines."""
    names = ["_h", "_id", "_d", "_c", "_pos"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bytes] = {}
        out: list[list] = [[] for _ in names]
        for batch in batches:
            for text, *key in zip(batch.column(3), *(batch.column(c).to_pylist() for c in range(3))):
                found = _hashes(text.as_py(), min_chars, seen)
                out[0] += [h for _, h in found]
                out[4] += [pos for pos, _ in found]
                for column, value in zip(out[1:], key):
                    column += [value] * len(found)
                if len(out[0]) >= 20_000:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names=names)
                    out = [[] for _ in names]
        if out[0]:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    return run


def _stream_first(min_docs: int):
    """Rows sorted by (hash, document desc, position) -> the rows that go, with null hashes, and undecided rows with theirs.

    Undecided are all rows of the partition's first hash, which may have begun before.  Of the last, which may go on, the first
    row of each of ``min_docs`` documents comes along, enough to name the keeper and reach the count; so do rows of a
    document with more than ``HELD`` equal lines.
    """
    names = ["_h", "_id", "_d", "_c", "_pos"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        first: list[tuple] = []  # of the hash of now, the first row of each document
        held: list[tuple] = []  # its rows that wait for the count
        now, opening, spilled = None, True, False

        def put(rows: list[tuple], h: bytes | None) -> None:
            if rows:
                out[0].extend([h] * len(rows))
                for column, values in zip(out[1:], zip(*rows)):
                    column.extend(values)

        for batch in batches:
            for h, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if h != now:
                    if spilled:
                        put(first, now)
                    opening, now, first, held, spilled = now is None, h, [row], [], False
                elif row[0] != first[-1][0] and len(first) < min_docs:
                    first.append(row)
                if opening:
                    put([row], h)
                elif row[0] != first[0][0]:
                    if len(first) < min_docs:
                        held.append(row)
                        if len(held) > HELD:
                            put(held, h)
                            held, spilled = [], True
                    else:
                        put([*held, row], None)
                        held = []
            if len(out[0]) >= 20_000:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names=names)
                out = [[] for _ in names]
        if not opening:
            put(first + held, now)
        if out[0]:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    return run


def dropped_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Rows (_id, _d, _c, _pos) of the lines that go; lines: _h, _id, _d, _c, _pos.

    A document is an id; rows without one are one document, below all others.
    """
    ordered = lines.repartitionByRange(F.asc("_h"), F.desc_nulls_last("_id"), F.asc("_pos")).sortWithinPartitions(F.asc("_h"), F.desc_nulls_last("_id"), F.asc("_pos"))
    streamed = materialise(ordered.mapInArrow(_stream_first(min_docs), "_h binary, _id long, _d long, _c long, _pos int"), "streamed")
    sure = streamed.where("_h is null").drop("_h")
    edge = streamed.where("_h is not null")
    # documents first, so a hot hash folds in each task
    hot = edge.groupBy("_h", "_id").agg(F.lit(1).alias("_one")).groupBy("_h").agg(F.count("*").alias("_n"), F.max("_id").alias("_keeper")).where(F.col("_n") >= min_docs)
    hot = hot.select(fresh(F.hex("_h")).alias("_j"), "_keeper")
    met = edge.join(hot, fresh(F.hex("_h")) == F.col("_j")).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    return sure.unionByName(met.select(*sure.columns))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bitmaps of kept lines for the documents that lose some: columns _key, _keep (compressed bits), _lost.

    ``_key`` is ``row_key(id, text)``; rows absent here keep all their lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_d"), F.crc32(utf8(F.col(text_col))).alias("_c"), F.col(text_col).alias("_text"))
    lines = materialise(slim.mapInArrow(_emit_lines(min_chars), "_h binary, _id long, _d long, _c long, _pos int"), "lines")
    lost = dropped_lines(lines, min_docs).groupBy(key_of_parts(F.col("_id"), F.col("_d"), F.col("_c")).alias("_key")).agg(F.collect_set("_pos").alias("_at"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, n = [], []
            for at in batch.column(1).to_pylist():
                keep = np.ones(max(at) // 8 * 8 + 8, np.uint8)  # whole bytes: lines past the end are kept
                keep[at] = 0
                bits.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
                n.append(len(at))
            yield pa.record_batch([batch.column(0), pa.array(bits, pa.binary()), pa.array(n, pa.int64())], names=["_key", "_keep", "_lost"])

    return lost.mapInArrow(packed, "_key string, _keep binary, _lost long")


def apply_bitmap(text: str | None, keep: bytes | None) -> str:
    """The lines of ``text`` that the bitmap keeps, joined by \\n.  Lines past its end are kept."""
    text = text or ""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return "\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", lost: str = "_lost") -> DataFrame:
    """All rows and columns of ``docs`` with the text that is left, and beside them ``lost``, the lines dropped (it takes
    the place of a column of that name).

    A line whose key has at least ``min_chars`` code points and lies in at least ``min_docs`` documents goes from all but
    the largest id that holds it.  A document is an id: rows that share one count once and keep or lose alike.  Rows with a
    null id are one document, below all others.  A null or empty text is one empty line.  Empty tables give empty results.
    """
    bound_batches(docs.sparkSession)
    bits = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col)
    keyed = boxed(docs, row_key(F.col(id_col), F.col(text_col)).alias("_own"))
    apply = F.pandas_udf(lambda text, keep: _applied(text, keep), "string")
    joined = keyed.join(bits, F.col("_own") == F.col("_key"), "left")
    text = F.col("row")[text_col]
    left = F.when(F.col("_keep").isNull(), F.coalesce(text, F.lit(""))).otherwise(apply(text, F.col("_keep")))
    out = [(left if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c != lost]
    return joined.select(*out, F.coalesce("_lost", F.lit(0)).cast("long").alias(lost))


def _applied(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([t if k is None else apply_bitmap(t, k) for t, k in zip(text, keep)], dtype=object)
