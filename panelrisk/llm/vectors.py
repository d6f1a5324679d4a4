"""What the operators on vectors share: usable rows, matrices of a batch, and sortable keys."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers that are finite."""
    limit = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < limit, F.lit(False)))


def width(df: DataFrame, vector: str) -> int:
    """The longest vector's length; shorter ones count as filled up with zeros."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """A batch of vectors as rows of ``dim`` components, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), kind)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


_KINDS = {"u1": np.uint8, "i8": np.int64}


def packed(parts: Sequence[np.ndarray]) -> list[bytes]:
    """Keys whose byte order is the order of the parts: int64 or uint8 arrays of one length."""
    out = np.empty((len(parts[0]), sum(p.dtype.itemsize for p in parts)), np.uint8)
    at = 0
    for part in parts:
        size = part.dtype.itemsize
        if size == 8:  # the sign bit turned, so that negative numbers come first
            part = part.view(np.uint64) ^ np.uint64(1 << 63)
        out[:, at : at + size] = np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).view(np.uint8).reshape(-1, size)
        at += size
    flat = out.tobytes()
    return [flat[i : i + at] for i in range(0, len(flat), at)]


def unpacked(keys: Sequence[bytes], kinds: Sequence[str]) -> list[np.ndarray]:
    """The parts of packed keys; ``kinds`` are "i8" and "u1"."""
    sizes = [int(kind[1]) for kind in kinds]
    rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, sum(sizes))
    out, at = [], 0
    for kind, size in zip(kinds, sizes):
        part = np.ascontiguousarray(rows[:, at : at + size])
        if kind == "i8":
            out.append((part.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64))
        else:
            out.append(part.ravel())
        at += size
    return out
