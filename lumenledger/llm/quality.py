"""A byte-level convolutional network for document quality, in numpy.

The bytes of a whole document are laid out in cells of 256.  A byte is a learned vector and one more channel, which says whether
it ends ``SAME`` bytes that stood at most ``LAGS`` bytes before as well, as in words said over and over.  Filters of eight
bytes move over them in steps of four; a cell keeps each filter's maximum, and a chunk is two neighbouring cells (512 bytes, half
overlapping the next chunk).  The chunks' maxima are combined over the document by their mean and their maximum, and
one logistic unit turns these into a probability.  Nothing but bytes goes in.

Fitting takes a bounded sample: at most ``sample`` labelled rows, whole, of ``fit_bytes`` bytes together.  Scoring reads
every byte of every text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import batches_of, bound_batches, bytes_of, utf8

CELL, WIDTH, STEP, DIM, FILTERS = 256, 8, 4, 8, 24
SPOTS = CELL // STEP
INPUTS = DIM + 1
LAGS, SAME = 24, 5
FOLDS = 5


@dataclass
class Net:
    embed: np.ndarray  # (256, DIM)
    kernel: np.ndarray  # (WIDTH * INPUTS, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS + 1,), the last one the intercept


def repeats(flat: np.ndarray) -> np.ndarray:
    """Whether the SAME bytes that end here, none of them zero, stood up to LAGS bytes before."""
    out = np.zeros(len(flat), bool)
    for lag in range(2, LAGS + 1):
        if len(flat) < lag + SAME:
            break
        same = (flat[lag:] == flat[:-lag]) & (flat[lag:] != 0)
        run = same[SAME - 1 :].copy()
        for j in range(1, SAME):
            run &= same[SAME - 1 - j : len(same) - j]
        out[lag + SAME - 1 :] |= run
    return out


def layout(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end -> bytes and repeat marks of their cells, both (cells, CELL + WIDTH - STEP), and the first cell of
    each text.

    A filter at the end of a cell sees the start of the next one of the same text, and zeros beyond the text.  Texts
    are followed by enough zeros that nothing repeats across them.
    """
    n = np.diff(at)
    cells = -(-(n + LAGS + SAME) // CELL)
    first = np.concatenate([[0], np.cumsum(cells)])
    flat = np.zeros(int(first[-1]) * CELL, np.uint8)
    if len(raw):
        flat[np.arange(len(raw)) + np.repeat(first[:-1] * CELL - at[:-1], n)] = raw
    out = []
    for plane in (flat, repeats(flat).astype(np.uint8)):
        grid = plane.reshape(-1, CELL)
        over = np.zeros((len(grid), WIDTH - STEP), np.uint8)
        over[:-1] = grid[1:, : WIDTH - STEP]
        over[first[1:] - 1] = 0
        out.append(np.concatenate([grid, over], axis=1))
    return out[0], out[1], first


def _windows(net: Net, grid: np.ndarray, again: np.ndarray) -> np.ndarray:
    x = np.empty((*grid.shape, INPUTS), np.float32)
    x[:, :, :DIM] = np.take(net.embed, grid, axis=0)
    x[:, :, DIM] = again
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(grid), SPOTS, WIDTH * INPUTS), (s[0], STEP * s[1], s[2]))


def _combine(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell maxima -> document features; also each cell's chunk maxima and whether the next cell gave them."""
    nxt = np.full_like(h, -np.inf)
    nxt[:-1] = h[1:]
    nxt[first[1:] - 1] = -np.inf
    later = nxt > h
    chunk = np.maximum(h, nxt)
    n = np.diff(first)[:, None]
    mean = np.add.reduceat(chunk, first[:-1], axis=0) / n
    most = np.maximum.reduceat(h, first[:-1], axis=0)
    return np.concatenate([mean, most, np.ones((len(n), 1), h.dtype)], axis=1), chunk, later


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(net: Net, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    if len(at) <= 1:
        return np.zeros(0)
    grid, again, first = layout(raw, at)
    h = np.empty((len(grid), FILTERS), np.float32)
    for i in range(0, len(grid), 256):
        conv = _windows(net, grid[i : i + 256], again[i : i + 256]) @ net.kernel
        h[i : i + 256] = np.maximum(conv.max(axis=1) + net.bias, 0)
    return _sigmoid(_combine(h, first)[0].astype(np.float64) @ net.out)


def fit(texts: list[bytes], labels: list[int], epochs: int = 8, seed: int = 5) -> Net:
    """Train on whole texts by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        rng.normal(0, 0.15, (WIDTH * INPUTS, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.zeros(2 * FILTERS + 1),
    )
    y_all = np.asarray(labels, np.float64)
    if not len(texts):
        return net
    net.out[-1] = np.log((y_all.sum() + 1) / (len(y_all) - y_all.sum() + 1))
    params = ["embed", "kernel", "bias", "out"]
    m = {p: np.zeros_like(getattr(net, p), dtype=np.float64) for p in params}
    v = {p: np.zeros_like(getattr(net, p), dtype=np.float64) for p in params}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = 0.01 * (0.5 if epoch >= epochs * 0.7 else 1.0)
        for b in range(0, len(order), 32):
            some = order[b : b + 32]
            parts = [np.frombuffer(texts[i], np.uint8) for i in some]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            grid, again, first = layout(np.concatenate(parts), at)
            win = _windows(net, grid, again)
            conv = win @ net.kernel
            spot = conv.argmax(axis=1)  # (cells, FILTERS)
            h = np.take_along_axis(conv, spot[:, None, :], 1)[:, 0, :] + net.bias
            on = h > 0
            h = np.maximum(h, 0)
            feats, _, later = _combine(h, first)
            p = _sigmoid(feats @ net.out)
            dz = (p - y_all[some]) / len(some)
            grad = {"out": feats.T @ dz + 1e-4 * net.out}
            owner = np.repeat(np.arange(len(some)), np.diff(first))
            dmean = (dz / np.diff(first))[:, None] * net.out[:FILTERS]
            dh = np.where(later, 0, dmean[owner])
            dh[1:] += np.where(later, dmean[owner], 0)[:-1]
            top = h == np.maximum.reduceat(h, first[:-1], axis=0)[owner]
            ties = np.add.reduceat(top.astype(np.float64), first[:-1], axis=0)
            dh += np.where(top, (dz[:, None] * net.out[FILTERS:-1] / ties)[owner], 0)
            dh *= on
            grad["bias"] = dh.sum(0)
            gk = np.zeros_like(net.kernel, dtype=np.float64)
            ge = np.zeros_like(net.embed, dtype=np.float64)
            for f in range(FILTERS):
                live = np.flatnonzero(dh[:, f])
                if not live.size:
                    continue
                g, at_spot = dh[live, f], spot[live, f]
                gk[:, f] = g @ win[live, at_spot]
                bytes_ = grid[live[:, None], at_spot[:, None] * STEP + np.arange(WIDTH)]
                np.add.at(ge, bytes_, g[:, None, None] * net.kernel[:, f].reshape(WIDTH, INPUTS)[:, :DIM])
            grad["kernel"], grad["embed"] = gk, ge
            step += 1
            for name in params:
                g = grad[name]
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                value = getattr(net, name)
                value -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(value.dtype)
    return net


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


#: Bytes of labelled texts that a fit takes at most, but for its last text.
FIT_BYTES = 16 << 20


def train(docs: DataFrame, labels: DataFrame, sample: int = 5000, fit_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Net:
    """Fit on at most ``sample`` rows with labels outside fold 0, whole texts of any length.

    They are those of lowest hash among the ``2 * sample`` labelled ids of lowest hash, which are broadcast; the sample is full with the row
    at which their texts reach ``fit_bytes`` bytes.  Labels that are null, or
    of null ids, don't count; an id with several takes their rounded mean.  Rows of one id come in the order of their texts' hashes,
    equal ones once, so the sample is the same in every run.  The driver gets these texts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_i"), F.col(label_col).cast("double").alias("_y")).dropna()
    known = known.where(fold(F.col("_i")) != 0).groupBy("_i").agg(F.round(F.avg("_y")).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_i"), "_i").limit(2 * sample)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), utf8(F.col(text_col)).alias("_text"))
    joined = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_i")).select("_id", "_text", "_y")
    # sizes first, so that no more texts are sorted than are taken
    order = [F.xxhash64("_id").alias("a"), F.col("_id"), F.xxhash64("_text").alias("b")]
    sizes = joined.select(*order, F.octet_length("_text").alias("n")).distinct().orderBy("a", "_id", "b").limit(sample).collect()
    held, taken = 0, []
    for r in sizes:
        if held >= fit_bytes:
            break
        held += r["n"]
        taken.append((r["_id"], r["b"]))
    names = docs.sparkSession.createDataFrame(taken, "_want long, _hash long")
    lowest = joined.join(F.broadcast(names), (F.col("_id") == F.col("_want")) & (F.xxhash64("_text") == F.col("_hash"))).select("_id", "_text", "_y").distinct().collect()
    rows = sorted((zlib.crc32(str(r[0]).encode()), r[0], bytes(r[1]), r[2]) for r in lowest)
    return fit([r[2] for r in rows], [r[3] for r in rows])


def score_documents(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All rows and columns of ``docs`` with held_out, score and predicted.

    A null text scores as an empty one.  A null id isn't held out.
    """
    bound_batches(docs.sparkSession)
    held = net

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = []
        column = pa.array(texts, pa.binary())
        for part in batches_of(iter([pa.record_batch([column], names=["t"])]), 0):
            out.append(scores(held, *bytes_of(part.column(0))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return (
        docs.withColumn("held_out", F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)))
        .withColumn("score", scored(utf8(F.col(text_col))))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
