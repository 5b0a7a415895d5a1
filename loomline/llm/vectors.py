"""Vectors as whole numbers, many to a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products of whole numbers up to this size, summed over 2,048 components, are exact in double precision.
EXACT = 1 << 20


def scaled(column: pa.ListArray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * component) in 64 bits) for each vector length among the sound rows of column.

    Not sound are null and empty vectors and those with null or non-finite components. A product beyond 64 bits is an
    error.
    """
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        x = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, n)
        good = np.isfinite(x).all(axis=1)
        x = np.floor(scale * x[good])
        if not (np.abs(x) < 2.0**63).all():
            raise OverflowError(f"a component times {scale} exceeds 64 bits")
        yield at[good], x.astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, in 32 bits each where they fit, else in 64."""
    return x.astype(np.int32 if x.size == 0 or np.abs(x).max() < 2**31 else np.int64).tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    """The `count` numbers that `packed` stored."""
    return np.frombuffer(data, np.int32 if len(data) == 4 * count else np.int64).astype(np.int64)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a type in which sums of their products are exact: doubles, or Python's whole numbers."""
    small = all(a.size == 0 or np.abs(a).max() <= EXACT for a in arrays)
    return [a.astype(np.float64 if small else object) for a in arrays]
