"""Small helpers for whole texts inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_ROWS = 256

# bytes.translate tables. UTF-8 bytes from 0x80 on stay, so other letters are untouched.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ASCII_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
WORDS = bytes(c if b >= 0x80 or c in _ASCII_WORD else 0x20 for b, c in enumerate(LOWER))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of few rows, which bounds what Python holds of their texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of digits, letters a-z and characters beyond ASCII; null has none."""
    return data.translate(WORDS).split() if data else []


def spans_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of consecutive runs of the given lengths."""
    ends = np.cumsum(lengths)
    return ends - lengths, ends
