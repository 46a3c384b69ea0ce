"""Image and upload files: decoded pixels, headers, sizes, and validity."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.functions.names import extension

MAX_FILE_BYTES = 15 * 1024 * 1024
MAX_FILES = 10
ALLOWED = ("jpg", "jpeg", "png", "webp")


def scratch(spark: SparkSession, name: str) -> str:
    """An unused path, deleted when the driver ends, in ``spark.checkpoint.dir``, which driver and executors share; without it, in tests, a temporary folder.

    On a cluster the setting is needed, as executors would write to disks of their own.
    """
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not said and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(said or 'file://' + tempfile.mkdtemp(prefix='lumen-')).rstrip('/')}/lumen-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images in BGR order: path, length of the file, height, width, channels, pixels; unreadable files have height -1.

    Length comes from the listing that the read makes anyway, so no second one is needed.
    """
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.col("image.origin").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"),
    )


def dimensions(spark: SparkSession, path: str) -> DataFrame:
    """Width and height of each readable file."""
    return decoded(spark, path).where("height >= 0").select("path", "width", "height")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Path and length, without reading contents (the column is pruned)."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def webp_size(content: Column) -> Column:
    """(width, height) from the header of a WebP file of any of its three kinds, null for none; nothing is decoded."""
    byte = lambda i: F.conv(F.hex(F.substring(content, i + 1, 1)), 16, 10).cast("long")
    number = lambda i, n: sum((byte(i + k) * 256**k for k in range(1, n)), byte(i))
    tag = lambda i: F.hex(F.substring(content, i + 1, 4))
    code = lambda text: text.encode().hex().upper()
    whole = (tag(0) == code("RIFF")) & (tag(8) == code("WEBP")) & (number(4, 4) + 8 <= F.octet_length(content))
    lossless = number(21, 4)
    size = (
        F.when((tag(12) == code("VP8 ")) & (F.hex(F.substring(content, 24, 3)) == "9D012A"), F.struct((number(26, 2) % 16384).alias("width"), (number(28, 2) % 16384).alias("height")))
        .when((tag(12) == code("VP8L")) & (byte(20) == 0x2F), F.struct((lossless % 16384 + 1).alias("width"), (F.shiftright(lossless, 14) % 16384 + 1).alias("height")))
        .when(tag(12) == code("VP8X"), F.struct((number(24, 3) + 1).alias("width"), (number(27, 3) + 1).alias("height")))
    )
    return F.when(whole, size)


def judged_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Every file with the reason why it is refused, null if it is taken.

    Extension and size come first, without reading contents; only what is left is opened.  WebP files, which Spark doesn't decode, are
    judged by their headers.  Spark lists no empty files.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    ending = extension(F.col("path"))
    first = F.when(~ending.isin(*ALLOWED), "extension").when(F.col("length") > MAX_FILE_BYTES, "size")
    files = file_sizes(spark, path).withColumn("refused", first)
    kinds = lambda *names: "{" + ",".join("*." + "".join(f"[{c}{c.upper()}]" for c in n) for n in names) + "}"
    pixels = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", kinds("jpg", "jpeg", "png")).load(path)
    shown = pixels.select(F.col("image.origin").alias("_p"), (F.col("image.height") >= 0).alias("readable"))
    webp = spark.read.format("binaryFile").option("pathGlobFilter", kinds("webp")).load(path).where(F.col("length") <= MAX_FILE_BYTES)
    shown = shown.unionByName(webp.select(F.col("path").alias("_p"), webp_size(F.col("content")).isNotNull().alias("readable")))
    both = files.join(shown, plain(F.col("path")) == plain(F.col("_p")), "left")
    return both.select("path", "length", F.coalesce("refused", F.when(~F.coalesce("readable", F.lit(False)), "unreadable")).alias("refused"))
