"""Pages as grey rasters: to 8 bits, and their histograms without margins and specks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.workers import let_workers_import

#: Fixed value: the share of each side that scanner edges darken, one part in so many.
_MARGIN = 20


def to_8bit(values: Column) -> Column:
    """16-bit grey values scaled down, not clipped."""
    return F.transform(values, lambda v: F.shiftright(v.cast("int"), 8))


def _median(image: np.ndarray) -> np.ndarray:
    """The median of each pixel and its eight neighbours; edges count on beyond themselves."""
    wide = np.pad(image, 1, mode="edge")
    rows, columns = image.shape
    return np.sort(np.stack([wide[y : y + rows, x : x + columns] for y in range(3) for x in range(3)]), axis=0)[4]


def histogram(content: bytes, width: int, height: int) -> np.ndarray:
    """How often each of 256 grey values occurs, specks and margins left out."""
    image = np.frombuffer(content, np.uint8)[: width * height].reshape(height, width)
    x, y = width // _MARGIN, height // _MARGIN
    return np.bincount(_median(image[y : height - y, x : width - x]).ravel(), minlength=256)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, values, counts = [], [], []
        for key, content, width, height in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if not content or not width or not height or len(content) < width * height:
                continue
            found = histogram(content, width, height)
            some = np.flatnonzero(found)
            keys += [key] * len(some)
            values.append(some)
            counts.append(found[some])
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(flat(values), pa.int32()), pa.array(flat(counts), pa.int64())], names=[batch.schema.names[0], "value", "n"])


def histograms(rasters: DataFrame, key: str) -> DataFrame:
    """rasters: key, content (8-bit grey, row by row), width, height. (key, value, n), as ``layout.ink_coverage`` takes it; what holds too few bytes has none."""
    let_workers_import(rasters.sparkSession)
    rows = rasters.select(key, "content", "width", "height")
    return rows.mapInArrow(_batches, f"`{key}` {rows.schema[key].dataType.simpleString()}, value int, n long")
