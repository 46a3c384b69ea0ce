"""Perceptual hashes of pixels: a cosine transform of the image shown small, cut at its median to 64 bits.

An image of any size is taken to ``GRID`` x ``GRID`` by area (each cell is the mean of what it covers) and transformed; its 8 x 8 lowest
frequencies are compared with their median.  Both steps are linear, so they are one matrix for a height and one for a width, rounded to
whole numbers: the transform of bytes is exact in doubles, and every engine finds the same bits.  A change of brightness moves one
coefficient, a change of contrast scales all alike, and a change of size averages out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.functions.image_metrics import gray, pixels

GRID, SIDE = 32, 8
#: Weights are whole numbers of this part of one.
SCALE = 1 << 14
#: Name -> (top, left, height, width) as parts of the image.  Four corners and the middle, three quarters each.
CROPS: dict[str, tuple[float, float, float, float]] = {
    "top_left": (0, 0, 0.75, 0.75), "top_right": (0, 0.25, 0.75, 0.75), "bottom_left": (0.25, 0, 0.75, 0.75),
    "bottom_right": (0.25, 0.25, 0.75, 0.75), "middle": (0.125, 0.125, 0.75, 0.75),
}
FULL = "full"


def area_weights(n: int, m: int) -> np.ndarray:
    """m x n: what part of each of m equal cells each of n pixels covers."""
    edge = np.arange(m + 1) * n / m
    at = np.arange(n)
    covered = np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at)
    return np.maximum(covered, 0) * m / n


@lru_cache(maxsize=1024)
def basis(n: int) -> np.ndarray:
    """SIDE x n whole weights: the lowest cosine frequencies of n pixels taken to GRID cells by area."""
    u, i = np.arange(SIDE)[:, None], np.arange(GRID)
    waves = np.cos(np.pi * (2 * i + 1) * u / (2 * GRID))
    return np.floor(SCALE * (waves @ area_weights(n, GRID)) + 0.5)


def phash(plane: np.ndarray) -> str:
    """16 hex digits of a plane of bytes; the first bit is that of the lowest frequency.

    A bit is one if its coefficient is above the median, the mean of the two in the middle.
    """
    found = (basis(plane.shape[0]) @ plane.astype(np.float64) @ basis(plane.shape[1]).T).ravel()
    middle = np.sort(found)[31:33].sum()
    return np.packbits(2 * found > middle).tobytes().hex()


def window(height: int, width: int, part: tuple[float, float, float, float]) -> tuple[slice, slice]:
    """Rows and columns of a crop: at least one pixel, whole pixels towards the top left."""
    top, left = int(height * part[0]), int(width * part[1])
    return slice(top, top + max(1, int(height * part[2]))), slice(left, left + max(1, int(width * part[3])))


def hashes_of(plane: np.ndarray, crops: dict[str, tuple[float, float, float, float]]) -> list[tuple[str, str]]:
    """(kind, hash): the whole plane's first, then those of crops that differ from all before."""
    out = [(FULL, phash(plane))]
    for kind, part in crops.items():
        found = phash(plane[window(*plane.shape, part)])
        if all(found != h for _, h in out):
            out.append((kind, found))
    return out


def _hashed(kind: str, crops: dict[str, tuple[float, float, float, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data, h, w, c in zip(*(col.to_pylist() for col in batch.columns)):
                if data is not None and h is not None and h > 0 and w > 0:
                    rows += [(key, i, name, found) for i, (name, found) in enumerate(hashes_of(gray(pixels(data, h, w, c)), crops))]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(list(col), t) for col, t in zip(columns, kinds)], names=["key", "place", "hash_kind", "phash"])

    return run


def image_hashes(images: DataFrame, key: str = "path", crops: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Candidates of every decoded image (key, pixels, height, width, channels): key, place (0 for the whole), hash_kind, phash.

    Each hash comes once an image, the whole's first.  Unreadable images (height below 1) have none.  ``sources.files.decoded`` gives the
    columns for PNG and JPEG files.
    """
    chosen = CROPS if crops is None else crops
    slim = images.select(F.col(key).alias("key"), "pixels", "height", "width", "channels")
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(_hashed(kind, chosen), f"key {kind}, place int, hash_kind string, phash string").withColumnRenamed("key", key)


def plane_images(vectors: DataFrame, side: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors of side * side components as gray images (id, pixels, height, width, channels): byte = floor((c + 0.5) * 255) in range."""

    def shade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, side * side)
            data = np.clip(np.floor((flat + 0.5) * 255), 0, 255).astype(np.uint8)
            sizes = [pa.array([x] * len(data), pa.int32()) for x in (side, side, 1)]
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in data], pa.binary()), *sizes], names=["id", "pixels", "height", "width", "channels"])

    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) == side * side) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c))
    slim = vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>"))
    return slim.mapInArrow(shade, "id long, pixels binary, height int, width int, channels int")
