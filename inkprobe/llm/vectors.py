"""Columns of vectors as numpy matrices inside Arrow batches, and Hilbert keys of their rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite entries only; false for null and for no entries."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as doubles; every list must hold ``width`` entries."""
    return pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_numbers(values: np.ndarray, factor: int, most: int) -> np.ndarray:
    """floor(factor * value) as int64, saturated at +-``most``."""
    return np.clip(np.floor(values * factor), -most, most).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of ``cells`` (rows x axes, 0 to 2**bits - 1) on a Hilbert curve, as bytes in curve order.

    Skilling's method (AIP Conference Proceedings 707, 2004): undo excess work from the
    highest bit down, Gray-encode, and read the bits of all axes plane by plane.
    """
    x = cells.T.astype(np.uint32)
    axes, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(axes):
            set_here = (x[i] & q) != 0
            swap = np.where(set_here, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_here, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.uint32), top
    while q > 1:
        turn ^= np.where(x[-1] & q, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    planes = np.concatenate([(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(planes.T, axis=1)]
