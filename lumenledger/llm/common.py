"""What the operators of this subpackage share: reading, scratch tables, row numbers, batches.

Conventions that hold for every operator here:

* An operator first projects the columns it needs to its own names (``_id``, ``_text`` ...), so columns
  beside them never clash and are ignored.
* A null text counts as an empty one. A null id is kept; each docstring says what it means.
* Nothing that grows with the corpus is collected to the driver.  What is broadcast has a stated bound.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own_dirs: dict[int, str] = {}
_written: dict[str, object] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: Rows and bytes of one Arrow batch between Spark and a Python worker: texts have no bound, batches do.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, if they are larger."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        said = spark.conf.get(key, None)
        if said is None or not said.lstrip("-").isdigit() or not 0 < int(said) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by Spark's own reader, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests on one machine, a temporary folder takes its place; on a cluster that is an error, as executors would
    write to disks of their own.
    """
    said = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
    key = id(spark.sparkContext)
    if key not in _own_dirs:
        _own_dirs[key] = "file://" + tempfile.mkdtemp(prefix="lumen-scratch-")
    return _own_dirs[key]


def _remove(path: str, spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_scratch() -> None:
    """Delete every scratch table written so far.  Frames still reading them become invalid."""
    for path, spark in list(_written.items()):
        _remove(path, spark)
        del _written[path]


def new_scratch_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, deleted when the driver ends or by ``drop_scratch``."""
    if not _written:
        atexit.register(drop_scratch)
    path = f"{shared_dir(spark)}/lumen-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and no executor holds it."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the scratch tables that ``materialise`` returned as these frames; frames made from them become invalid."""
    for df in frames:
        path = _paths.pop(df, None)
        if path in _written:
            _remove(path, _written.pop(path))


@contextlib.contextmanager
def scratch_scope() -> Iterator[list[DataFrame]]:
    """Delete at the end what was written inside, except what the frames put into the list stand for.

    For work that is done with inside: frames that still read what goes become invalid.
    """
    before, kept = set(_written), []
    try:
        yield kept
    finally:
        held = {_paths.get(df) for df in kept}
        for path in [p for p in _written if p not in before and p not in held]:
            _remove(path, _written.pop(path))


def discard(df: DataFrame) -> None:
    """``release``, and let Spark drop shuffles that nothing refers to.

    Shuffle files go when the driver's garbage is collected; asking for it keeps a job's disk to what it still needs.
    """
    release(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def fresh_long(key: Column) -> Column:
    """``fresh`` for a key of 64-bit integers."""
    return key.bitwiseXOR(F.lit(1).cast("long"))


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b"").cast("binary"))


def boxed(df: DataFrame, *beside: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row`` with others beside it, so that no names clash; ``row.*`` unpacks it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *beside)


def row_key(id_col: Column, text: Column) -> Column:
    """A key for a row made from its content: equal rows share it and get equal results.

    It needs no numbering of rows, so it is the same in every scan and after every retry.
    """
    return key_of_parts(id_col, F.xxhash64(F.coalesce(text, F.lit(""))), F.crc32(utf8(text)))


def key_of_parts(id_col: Column, text_hash: Column, checksum: Column) -> Column:
    """``row_key`` from an id and two hashes of the text."""
    return F.concat_ws("\x1f", F.coalesce(id_col.cast("string"), F.lit("~")), text_hash.cast("string"), checksum.cast("string"))


def fresh(key: Column) -> Column:
    """The same key as another expression.

    A join on it can't reuse the partitioning of an aggregation before it, so both sides get an exchange
    of their own and adaptive execution may split a hot key of the larger side.
    """
    return F.concat(F.lit("="), key.cast("string"))


def number_rows(df: DataFrame, *order: str, name: str = "_row") -> tuple[DataFrame, int]:
    """Number all rows from 0 in the order given; returns the numbered rows and their count.

    One range exchange and a local sort.  A row's number is its place in its partition plus the sizes of the
    partitions before; those sizes are one row a partition, which bounds the only broadcast and the only
    window over one partition.
    """
    placed = materialise(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    )
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(2**33 - 1))
    sizes = placed.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sizes.withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))), "starts")
    total = starts.agg(F.sum("count")).first()[0] or 0
    out = placed.join(F.broadcast(starts.drop("count")), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), int(total)


def batches_of(batches: Iterator[pa.RecordBatch], text_column: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one longer text."""
    for batch in batches:
        column = batch.column(text_column)
        lengths = np.diff(offsets_of(column)) if len(column) else np.zeros(0, np.int64)
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(column) > start:
            yield batch.slice(start)


def offsets_of(column: pa.Array) -> np.ndarray:
    """Offsets of a binary or string array into its data buffer."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string array end to end, and the offsets of its values in them.

    Nulls count as empty.
    """
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    at = offsets_of(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
