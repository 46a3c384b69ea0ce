"""Random crops and blurs that come out the same in every run.

The generator has no state: a number is a hash of (id, iteration, stream), so it depends on neither the partitioning nor the order of
rows, and a task that is tried again draws what it drew before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenledger.functions.image_metrics import RESIZE, blurred, pixels, to_bytes

#: Streams of the generator.
SCALE_OF, TOP, LEFT, BLUR = range(4)


def uniform(key: Column, iteration: Column, stream: int) -> Column:
    """A number in [0, 1) for (key, iteration, stream): 32 bits of a digest of the three."""
    text = F.concat_ws(":", key.cast("string"), iteration.cast("string"), F.lit(str(stream)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def box_of(key: Column, iteration: Column, height: Column, width: Column, smallest: float = 0.8, sigma: tuple[float, float] = (0.1, 1.0)) -> Column:
    """A struct of top, left, box_height, box_width and sigma for an image and an iteration.

    A box has from ``smallest`` to all of the height and width, at least one pixel, and lies anywhere in the image.
    """
    u = lambda stream: uniform(key, iteration, stream)
    part = F.lit(smallest) + u(SCALE_OF) * F.lit(1 - smallest)
    side = lambda n: F.greatest(F.lit(1), F.floor(n * part)).cast("int")
    place = lambda stream, n: F.floor(u(stream) * (n - side(n) + 1)).cast("int")
    blur = F.lit(sigma[0]) + u(BLUR) * F.lit(sigma[1] - sigma[0])
    return F.struct(place(TOP, height).alias("top"), place(LEFT, width).alias("left"), side(height).alias("box_height"), side(width).alias("box_width"), blur.alias("sigma"))


def crop_boxes(images: DataFrame, iterations: int, key: str = "id", smallest: float = 0.8, sigma: tuple[float, float] = (0.1, 1.0)) -> DataFrame:
    """The boxes of every image (key, height, width) for iterations from 0: key, iteration, top, left, box_height, box_width, sigma."""
    at = images.select(key, "height", "width", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    return at.select(key, "iteration", box_of(F.col(key), F.col("iteration"), F.col("height"), F.col("width"), smallest, sigma).alias("box")).select(key, "iteration", "box.*")


@F.pandas_udf(T.BinaryType())
def cut_and_blur(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, top: pd.Series, left: pd.Series, box_height: pd.Series, box_width: pd.Series, sigma: pd.Series) -> pd.Series:
    """The box of each image, back at its full size (bilinear) and blurred, as bytes."""
    out = []
    for d, h, w, c, y, x, bh, bw, s in zip(data, height, width, channels, top, left, box_height, box_width, sigma):
        box = pixels(d, h, w, c)[y : y + bh, x : x + bw]
        out.append(to_bytes(blurred(RESIZE["bilinear"](box, h, w), s)).tobytes())
    return pd.Series(out)


def augmented(images: DataFrame, iterations: int, key: str = "id", smallest: float = 0.8, sigma: tuple[float, float] = (0.1, 1.0)) -> DataFrame:
    """Every readable image (key, pixels, height, width, channels) once an iteration, cropped and blurred: key, iteration, pixels.

    Boxes are computed beside the pixels, so images aren't shuffled.
    """
    at = images.where("height > 0 and width > 0").withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    shown = at.withColumn("box", box_of(F.col(key), F.col("iteration"), F.col("height"), F.col("width"), smallest, sigma))
    made = cut_and_blur("pixels", "height", "width", "channels", "box.top", "box.left", "box.box_height", "box.box_width", "box.sigma")
    return shown.select(key, "iteration", made.alias("pixels"))
