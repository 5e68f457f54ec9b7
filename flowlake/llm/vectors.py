"""Integer vectors from arrays of numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 1 << 26  # of a scaled component: products of two still add up exactly in 64 bits


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component x, as an array of int.

    Null where the vector is null, holds a null, NaN or infinite component, or one whose scaled
    value lies beyond +-``LARGEST`` (its products would not fit 64 bits).
    """
    fits = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) * scale < LARGEST))
    return F.when(fits, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column as one matrix; shorter rows are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    offsets = np.asarray(column.offsets)
    sizes = np.diff(offsets)
    most = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == most).all():
        return flat.reshape(len(sizes), most)
    out = np.zeros((len(sizes), most), dtype=flat.dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out
