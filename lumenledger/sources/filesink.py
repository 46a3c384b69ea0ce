"""Sinks that write one file a row, lossless images or blobs, and show all files of a write at once.

``register(spark)`` makes the formats known.  ``df.write.format("lumen_png").mode("append").save(folder)`` writes columns name, pixels,
height, width, channels (as ``files.decoded`` shows them, channels in BGR order) as PNG files; ``lumen_blob`` writes name and content as they
are, for ciphertexts and the like.  A task writes under a staging folder; the commit removes what tasks tried in vain and renames the
folder, one step however many files there are; an abort deletes it.  So a reader never sees half of a write, and a task that fails
leaves nothing.  Spark's ``image`` and ``binaryFile`` sources read the files back with ``recursiveFileLookup``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lumenledger.functions.image_metrics import pixels

PNG, BLOB = "lumen_png", "lumen_blob"
#: Channels -> the format's number for gray, colour, and colour with opacity.
_COLOUR = {1: 0, 3: 2, 4: 6}


def _chunk(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


def _filtered(rows: np.ndarray, step: int) -> bytes:
    """Every row under the one of the format's five filters that leaves the smallest sum of differences."""
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, step:], up[1:] = rows[:, :-step], rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, step:] = rows[:-1, :-step]
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    near = np.abs(np.stack([b - c, a - c, a + b - 2 * c]))
    paeth = np.choose(near.argmin(0), [left, up, corner])
    tried = np.stack([rows, rows - left, rows - up, rows - ((a + b) // 2).astype(np.uint8), rows - paeth])
    best = np.abs(tried.view(np.int8).astype(np.int64)).sum(2).argmin(0)
    chosen = tried[best, np.arange(len(rows))]
    return np.concatenate([best[:, None].astype(np.uint8), chosen], axis=1).tobytes()


def encode(image: np.ndarray) -> bytes:
    """A PNG file of height x width x channels bytes: gray, BGR, or BGR with opacity."""
    h, w, channels = image.shape
    if not (h and w and channels in _COLOUR):
        raise ValueError(f"no image: {image.shape}")
    if channels > 1:
        image = np.concatenate([image[:, :, 2::-1], image[:, :, 3:]], axis=2)
    head = struct.pack(">IIBBBBB", w, h, 8, _COLOUR[channels], 0, 0, 0)
    body = zlib.compress(_filtered(np.ascontiguousarray(image).reshape(h, w * channels), channels), 6)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def plain_name(name: str | None) -> str:
    """The name, which can't hold a folder or be hidden."""
    if not name or "/" in name or name.startswith((".", "_")):
        raise ValueError(f"not a file name: {name!r}")
    return name


def png_name(name: str | None) -> str:
    """The name with the ending png in place of another."""
    base, dot, _ = plain_name(name).rpartition(".")
    return f"{base if dot and base else name}.png"


def _png(row: dict) -> tuple[str, bytes]:
    return png_name(row["name"]), encode(pixels(row["pixels"], row["height"], row["width"], row["channels"]))


def _blob(row: dict) -> tuple[str, bytes]:
    return plain_name(row["name"]), row["content"] or b""


@dataclass
class _Done(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str, made: Callable[[dict], tuple[str, bytes]]):
        self.root, self.made = root, made
        self.job = uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        store, root = self._store()
        task = TaskContext.get()
        folder = f"part={task.partitionId()}-{task.taskAttemptId()}"
        written = 0
        for batch in iterator:
            for row in batch.to_pylist():
                name, data = self.made(row)
                if not written:
                    store.create_dir(f"{root}/_staging-{self.job}/{folder}")
                with store.open_output_stream(f"{root}/_staging-{self.job}/{folder}/{name}") as out:
                    out.write(data)
                written += 1
        return _Done(folder, written)

    def commit(self, messages: list[_Done | None]) -> None:
        store, root = self._store()
        staged = f"{root}/_staging-{self.job}"
        kept = {m.folder for m in messages if m is not None and m.files}
        if not kept:
            return
        for found in store.get_file_info(fs.FileSelector(staged)):
            if found.base_name not in kept:
                store.delete_dir(found.path)
        store.move(staged, f"{root}/write={self.job}")

    def abort(self, messages: list[_Done | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/_staging-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_staging-{self.job}")


class _Sink(DataSource):
    columns: dict[str, str]
    made: Callable[[dict], tuple[str, bytes]]

    def schema(self) -> str:
        return ", ".join(f"{n} {k}" for n, k in self.columns.items())

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("files are appended; overwriting isn't offered")
        missing = set(self.columns) - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        root = self.options["path"].rstrip("/")
        return _Writer(root if "://" in root or not root.startswith("file:") else "file://" + root.removeprefix("file:"), type(self).made)


class PngSink(_Sink):
    columns = {"name": "string", "pixels": "binary", "height": "int", "width": "int", "channels": "int"}
    made = staticmethod(_png)

    @classmethod
    def name(cls) -> str:
        return PNG


class BlobSink(_Sink):
    columns = {"name": "string", "content": "binary"}
    made = staticmethod(_blob)

    @classmethod
    def name(cls) -> str:
        return BLOB


def register(spark: SparkSession) -> None:
    for sink in (PngSink, BlobSink):
        spark.dataSource.register(sink)
