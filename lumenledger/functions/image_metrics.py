"""Image metrics in numpy, as pandas UDFs over decoded pixels (BGR bytes, row by row)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Luma weights for blue, green, red, in thousandths.
BGR_WEIGHTS = (114, 587, 299)
#: Channel means and deviations (red, green, blue) of the two usual image encoders.
CLIP_MEAN, CLIP_STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
WINDOW = 7


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def to_unit(image: np.ndarray) -> np.ndarray:
    """Height x width x BGR bytes -> RGB x height x width in [0, 1]."""
    return image[:, :, 2::-1].transpose(2, 0, 1).astype(np.float32) / np.float32(255)


def gray(image: np.ndarray) -> np.ndarray:
    if image.shape[2] == 1:
        return image[:, :, 0]
    # whole numbers, so that halves round alike everywhere
    return ((image[:, :, :3].astype(np.int32) @ np.array(BGR_WEIGHTS, np.int32) + 500) // 1000).astype(np.uint8)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres at half steps (corners not aligned)."""
    h, w = image.shape[:2]
    if (h, w) == (height, width):
        return image.astype(np.float64)

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.maximum((np.arange(m) + 0.5) * n / m - 0.5, 0)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(h, height)
    x0, x1, fx = axis(w, width)
    x = image.astype(np.float64)
    fy, fx = fy[:, None, None], fx[None, :, None]
    x = x if x.ndim == 3 else x[:, :, None]
    top = x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx
    low = x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx
    out = top * (1 - fy) + low * fy
    return out if image.ndim == 3 else out[:, :, 0]


def lanczos_weights(n: int, m: int, lobes: int = 3) -> np.ndarray:
    """m x n weights that resample n pixels to m: a windowed sinc of ``lobes`` lobes, each row of sum one.

    When shrinking, the window is stretched by n / m, so that every pixel counts; at the borders it is cut off and made whole again.
    """
    stretch = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    x = (np.arange(n) - centre[:, None]) / stretch
    out = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return out / out.sum(1, keepdims=True)


def lanczos(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resampled along columns, then along rows; values may leave the range of bytes."""
    x = image.astype(np.float64)
    x = np.tensordot(lanczos_weights(x.shape[0], height), x, (1, 0))
    return np.moveaxis(np.tensordot(lanczos_weights(x.shape[1], width), x, (1, 1)), 0, 1)


#: How the second of two images of different sizes takes the size of the first.
RESIZE = {"bilinear": resize, "lanczos": lanczos}


def to_bytes(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5).clip(0, 255).astype(np.uint8)


def gaussian(sigma: float, reach: float = 3.0) -> np.ndarray:
    """Weights of a Gaussian blur out to ``reach`` deviations, of sum one."""
    r = max(1, int(np.ceil(reach * sigma)))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """A separable Gaussian blur; borders are mirrored without repeating the edge."""
    w = gaussian(sigma)
    x = image.astype(np.float64)
    for axis in (0, 1):
        n, r = x.shape[axis], len(w) // 2
        fold = np.abs(np.arange(-r, n + r))
        fold = np.where(fold >= n, 2 * (n - 1) - fold, fold) % n if n > 1 else np.zeros(n + 2 * r, np.int64)
        padded = np.take(x, fold, axis)
        x = sum(wj * np.take(padded, np.arange(j, j + n), axis) for j, wj in enumerate(w))
    return x


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    mse = float(np.mean((a.astype(np.float64) - b.astype(np.float64)) ** 2))
    return float("inf") if mse == 0 else 10 * float(np.log10(255.0**2 / mse))


def _means(x: np.ndarray) -> np.ndarray:
    s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    s[1:, 1:] = x.cumsum(0).cumsum(1)
    w = WINDOW
    return (s[w:, w:] - s[:-w, w:] - s[w:, :-w] + s[:-w, :-w]) / (w * w)


def ssim(a: np.ndarray, b: np.ndarray, span: float = 255.0) -> float:
    """Mean structural similarity of two planes (Wang et al. 2004): a uniform 7 x 7 window, sample covariances."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if min(x.shape) < WINDOW:
        raise ValueError(f"images must be at least {WINDOW} pixels wide and high")
    n = WINDOW * WINDOW
    mx, my = _means(x), _means(y)
    vx, vy, vxy = (n / (n - 1) * (_means(p) - q) for p, q in ((x * x, mx * mx), (y * y, my * my), (x * y, mx * my)))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def ssim_colour(a: np.ndarray, b: np.ndarray) -> float:
    """The mean over channels; differs from the similarity of gray planes."""
    return float(np.mean([ssim(a[:, :, c], b[:, :, c]) for c in range(a.shape[2])]))


def quality(first: tuple, second: tuple, method: str = "bilinear", colour: bool = False) -> tuple[float, float]:
    """(SSIM, PSNR) of two decoded images (data, height, width, channels): of their gray planes, or of all channels.

    The second takes the first's size by a method of RESIZE.  (0, 0) if either is unreadable.
    """
    if min(first[1], second[1]) < 0:
        return 0.0, 0.0
    a, b = pixels(*first), pixels(*second)
    if a.shape[:2] != b.shape[:2]:
        b = to_bytes(RESIZE[method](b, *a.shape[:2]))
    if not colour:
        a, b = gray(a)[:, :, None], gray(b)[:, :, None]
    return ssim_colour(a, b), psnr(a, b)


def quality_by(method: str = "bilinear", colour: bool = False):
    """``quality`` as a pandas UDF over two structs (pixels, height, width, channels)."""

    @F.pandas_udf(T.StructType([T.StructField("ssim", T.DoubleType()), T.StructField("psnr", T.DoubleType())]))
    def judged(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        take = lambda df: zip(df["pixels"], df["height"], df["width"], df["channels"])
        return pd.DataFrame([quality(x, y, method, colour) for x, y in zip(take(a), take(b))], columns=["ssim", "psnr"])

    return judged


quality_udf = quality_by()


def compare(first: tuple, second: tuple) -> tuple[float, float]:
    """(SSIM of all channels, largest shift of a pixel as part of 1) of two decoded images; the second takes the first's size by Lanczos.

    (0, 1) if either is unreadable.
    """
    if min(first[1], second[1]) < 0:
        return 0.0, 1.0
    a, b = pixels(*first), pixels(*second)
    if a.shape[:2] != b.shape[:2]:
        b = to_bytes(lanczos(b, *a.shape[:2]))
    return ssim_colour(a, b), float(np.abs(a.astype(np.float64) - b).max() / 255)


@F.pandas_udf(T.StructType([T.StructField("ssim", T.DoubleType()), T.StructField("shift", T.DoubleType())]))
def compare_udf(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """``compare`` over two structs (pixels, height, width, channels)."""
    take = lambda df: zip(df["pixels"], df["height"], df["width"], df["channels"])
    return pd.DataFrame([compare(x, y) for x, y in zip(take(a), take(b))], columns=["ssim", "shift"])


def psnr_of(mse):
    """PSNR from a column of mean squared errors; infinite for 0."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(F.lit(65025.0) / mse))
