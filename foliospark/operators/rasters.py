"""Ruling lines of page rasters: gray pixels in, line positions out, as input for ``layout.ruled_tables``.

A raster is a row (width, height, pixels): one byte a pixel, row by row, dark is low. The kernel is numpy over Arrow batches;
a page's raster is all that a task holds beside its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: shares of a page's sides that make a line, and the least sizes in pixels
LEAST_LINE, LEAST_GAP, INK = 20, 8, 0.15
ACROSS, DOWN = 30, 40
X_SHARE, Y_SHARE = 0.08, 0.12
X_GAP, Y_GAP = 80, 90


def threshold(pixels: np.ndarray) -> int:
    """Otsu's threshold: the first gray value that parts the pixels with the largest variance between both sides."""
    counts = np.bincount(pixels.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(counts), counts.sum()
    sums = np.cumsum(counts * np.arange(256))
    weight = below * (total - below)
    # no pixels on one side: no variance
    return int(np.argmax(np.divide((sums[-1] * below / total - sums) ** 2, weight, out=np.zeros(256), where=weight > 0)))


def _stretched(mask: np.ndarray, length: int, join: np.ufunc) -> np.ndarray:
    """Each position along the rows joined with the ``length`` - 1 after it, in steps that double."""
    wide = 1
    while wide < length:
        step = min(wide, length - wide)
        mask = join(mask[..., :-step], mask[..., step:])
        wide += step
    return mask


def opened(ink: np.ndarray, length: int) -> np.ndarray:
    """Morphological opening along the rows: what is covered by stretches of ``length`` ink pixels; beyond the border counts as ink."""
    lead = length // 2
    wide = np.ones((ink.shape[0], ink.shape[1] + length - 1), bool)
    wide[:, lead:lead + ink.shape[1]] = ink
    fits = _stretched(wide, length, np.logical_and)  # eroded, one for each pixel
    wide = np.zeros_like(wide)
    wide[:, length - 1 - lead:length - 1 - lead + ink.shape[1]] = fits
    return _stretched(wide, length, np.logical_or)


def centres(hits: np.ndarray, gap: int) -> list[int]:
    """Positions whose neighbours lie within ``gap``, as one each: their mean, rounded down."""
    if not len(hits):
        return []
    starts = np.flatnonzero(np.concatenate(([True], hits[1:] - hits[:-1] > gap)))
    return (np.add.reduceat(hits, starts) // np.diff(starts, append=len(hits))).tolist()


def lines_of(pixels: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions of a page's vertical and horizontal ruling lines."""
    h, w = pixels.shape
    ink = pixels <= threshold(pixels)
    across, down = opened(ink, max(LEAST_LINE, w // ACROSS)), opened(ink.T, max(LEAST_LINE, h // DOWN))
    xs = np.flatnonzero(down.sum(1) > max(int(h * X_SHARE), 1) * INK)
    ys = np.flatnonzero(across.sum(1) > max(int(w * Y_SHARE), 1) * INK)
    return centres(xs, max(LEAST_GAP, w // X_GAP)), centres(ys, max(LEAST_GAP, h // Y_GAP))


def _marks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, axes, places = [], [], []
        for i, (w, h, raw) in enumerate(zip(b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("pixels"))):
            if not w or not h or not raw.is_valid or len(raw.as_buffer()) != w * h:
                continue
            for axis, found in zip("xy", lines_of(np.frombuffer(raw.as_buffer(), np.uint8).reshape(h, w))):
                rows += [i] * len(found)
                axes += axis * len(found)
                places += found
        yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(axes, pa.string()), pa.array(places, pa.int64())], names=[key, "axis", "at"])


def ruling_lines(rasters: DataFrame, key: str) -> DataFrame:
    """(key, axis, at) of the ruling lines of rasters (key, width, height, pixels); a raster whose bytes don't fit its size has none."""
    schema = T.StructType([rasters.schema[key], T.StructField("axis", T.StringType()), T.StructField("at", T.LongType())])
    return rasters.select(key, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels").mapInArrow(partial(_marks, key=key), schema)
