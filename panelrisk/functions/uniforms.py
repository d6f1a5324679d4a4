"""The deterministic uniform of every day of a calendar at once: MD5 in numpy, a vector of days for each key."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash's own constants: left rotations of its four rounds, sines, and the state it starts from.
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that fit into one block of the hash; messages that are hashed at a time.
_BLOCK, _MESSAGES = 55, 1 << 15


def md5_heads(messages: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each column of bytes, all of one length of at most 55."""
    length, n = messages.shape
    words = np.zeros((16, n), np.uint32)
    for k in range(length):
        words[k // 4] |= messages[k].astype(np.uint32) << np.uint32(8 * (k % 4))
    words[length // 4] |= np.uint32(0x80 << 8 * (length % 4))
    words[14] = 8 * length
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    f, other = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps don't reach the first 32 bits
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        if 4 * g <= length or g == 14:  # the other words are zero
            f += words[g]
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=other)
        f <<= np.uint32(turn)
        f |= other
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (b + np.uint32(_START[0])).astype("<u4").byteswap()


def day_millionths(keys: list[str | None], days: np.ndarray) -> np.ndarray:
    """(keys, days): the millionths of :func:`~panelrisk.functions.scalars.uniform` of 'key|day'; a null key leaves the day alone."""
    out = np.empty((len(keys), len(days)), np.int32)
    heads = [b"" if k is None else k.encode() + b"|" for k in keys]
    by_length: dict[int, list[int]] = {}
    for i, h in enumerate(heads):
        by_length.setdefault(len(h), []).append(i)
    many = max(1, _MESSAGES // max(1, len(days)))
    for length, at in by_length.items():
        if length + days.shape[1] > _BLOCK:
            texts = [bytes(d) for d in days]
            for i in at:
                out[i] = [int(hashlib.md5(heads[i] + t).hexdigest()[:8], 16) % 1000000 for t in texts]
            continue
        for k in range(0, len(at), many):
            part = at[k : k + many]
            rows = np.empty((length + days.shape[1], len(part), len(days)), np.uint8)
            rows[:length] = np.frombuffer(b"".join(heads[i] for i in part), np.uint8).reshape(len(part), length).T[:, :, None]
            rows[length:] = days.T[:, None, :]
            out[part] = (md5_heads(rows.reshape(len(rows), -1)) % np.uint32(1000000)).reshape(len(part), -1)
    return out


def _calendar(start: str, end: str) -> np.ndarray:
    """The days of [start, end] as rows of characters."""
    first = date.fromisoformat(start)
    texts = [(first + timedelta(k)).isoformat().encode() for k in range((date.fromisoformat(end) - first).days + 1)]
    return np.frombuffer(b"".join(texts), np.uint8).reshape(-1, 10)


def uniform_days(key: Column, start: str, end: str) -> Column:
    """An array with the millionths of ``uniform(key, day)`` for each day of [start, end]."""
    days = _calendar(start, end)

    @F.arrow_udf("array<int>")
    def millionths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = day_millionths(batch.to_pylist(), days)
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * len(days)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))

    return millionths(key.cast("string"))


def drawn(
    keys: list[str | None], rows: np.ndarray, at: np.ndarray, days: np.ndarray, share: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key's row, day's place, millionths) of the days whose uniform is below ``share``, and of the places ``at`` of the
    keys in ``rows``."""
    limit = np.searchsorted(np.arange(1000000) / 1e6, share)
    many = max(1, _MESSAGES * 16 // max(1, len(days)))
    found = []
    for k in range(0, len(keys), many):
        values = day_millionths(keys[k : k + many], days)
        kept = values < limit
        mine = (rows >= k) & (rows < k + many)
        kept[rows[mine] - k, at[mine]] = True
        row, place = np.nonzero(kept)
        found.append((row + k, place, values[row, place]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def drawn_days(key: Column, always: Column, start: str, end: str, share: float) -> Column:
    """An array of (at, u), in order: the days of [start, end], counted from its first, whose ``uniform(key, day)`` is below
    ``share`` or that are in the array ``always``, with the millionths of their uniforms."""
    days = _calendar(start, end)
    first = (date.fromisoformat(start) - date(1970, 1, 1)).days

    @F.arrow_udf("array<struct<at:int,u:int>>")
    def draw(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, wanted in batches:
            lengths = wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(keys)), lengths)
            at = wanted.flatten().cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64) - first
            inside = (at >= 0) & (at < len(days))
            row, place, values = drawn(keys.to_pylist(), rows[inside], at[inside], days, share)
            offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(keys)))].astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(values.astype(np.int32))], ["at", "u"])
            yield pa.ListArray.from_arrays(pa.array(offsets), items)

    return draw(key.cast("string"), always)
