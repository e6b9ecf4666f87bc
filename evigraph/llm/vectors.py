"""Whole-number vectors: the usable rows of a vector column, exact products and their packed form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all of its components are there and finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(vector: Column, factor: int) -> Column:
    """Each component x, as a double, as the whole number floor(factor * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of b, exact; an error where a sum could exceed 64 bits."""
    most = np.abs(a.astype("f8")).max(initial=0) * np.abs(b.astype("f8")).max(initial=0) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype("f8") @ b.T.astype("f8")).astype("i8")
    if most < 2**63:
        return a.astype("i8") @ b.T.astype("i8")
    raise OverflowError("components are too large for products of 64 bits")


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a from one row b, or from the rows of b in turn; exact, with the same limit."""
    most = np.abs(a.astype("f8")).max(initial=0) + np.abs(b.astype("f8")).max(initial=0)
    if most * most * max(1, a.shape[1]) >= 2**63:
        raise OverflowError("components are too large for squares of 64 bits")
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def packed(a: np.ndarray) -> bytes:
    """The numbers in the fewest bytes that hold all of them, behind one byte that names their size."""
    most = max(-int(a.min(initial=0)), int(a.max(initial=0)))
    kind = "2" if most < 1 << 15 else "4" if most < 1 << 31 else "8"
    return kind.encode() + a.astype(f"<i{kind}").tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    """The rows of packed(); the number of rows of width 0 is lost."""
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).reshape(-1, max(1, width))


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """A column of lists as rows of one width, the longest if none is given; a shorter list counts as zero beyond its end."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = max(1, int(sizes.max(initial=0))) if width is None else width
    values = lists.flatten().to_numpy(zero_copy_only=False).astype("i8")
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), "i8")
    out[np.arange(width) < sizes[:, None]] = values
    return out
