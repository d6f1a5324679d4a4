"""What the operators of this folder share: written tables, free column names, words and their hashes."""
from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Words are what stands between these six characters.
BLANKS = " \t\n\v\f\r"

#: Bytes whose words are hashed at a time.
SLICE = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; beside the warehouse where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table of its own in the shared folder and read it back, which cuts its lineage.

    Unlike a checkpoint this computes the rows once. The files go with the folder; ``forget`` drops them earlier.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the action that made them ends, for actions whose results are written tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if path.startswith(("file:", "/")) or "://" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks(sizes: Iterable[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``limit``; a single larger row is a range of its own."""
    out, begin, total, n = [], 0, 0, 0
    for n, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            out.append((begin, n))
            begin, total = n, 0
    if begin < n:
        out.append((begin, n))
    return out


#: Odd multipliers and the finisher that spread 64-bit values (fixed values of splitmix64).
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on every other."""
    x = values ^ (values >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x = x * _MIX[1]
    x ^= x >> np.uint64(31)
    return x


#: Each byte's value in a word's polynomial, and the polynomial's base (odd, so that it has an inverse).
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64, kept for the next call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


#: The six blanks as one.
BLANK_TO_SPACE = bytes(32 if chr(c) in BLANKS else c for c in range(256))


def hashed_words(texts: list[bytes], plain: bytes = BLANK_TO_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts, all in a row, and the number of words of each text.

    ``plain`` maps bytes and must make every blank a space. Words are found and hashed by array operations: a word's
    hash is a difference of running sums of byte values times powers of a base, shifted to the word's start.
    """
    counts = np.zeros(len(texts), np.int64)
    if not texts:
        return np.zeros(0, np.uint64), counts
    buffer = (b" ".join(texts) + b" ").translate(plain)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    parts, a = [], 0
    while a < len(buffer):
        z = len(buffer) if len(buffer) - a <= SLICE else buffer.rfind(b" ", a, a + SLICE) + 1 or buffer.index(b" ", a + SLICE) + 1
        data = np.frombuffer(buffer, np.uint8, z - a, a)
        word = np.r_[False, data != 32]
        edge = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edge[0::2], edge[1::2]
        power, inverse = _power_tables(max(SLICE, z - a))
        total = np.zeros(z - a + 1, np.uint64)
        np.cumsum(_VALUES[data] * power[: z - a], out=total[1:])
        parts.append(mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        counts += np.bincount(np.searchsorted(begin, starts + a, side="right") - 1, minlength=len(texts))
        a = z
    return np.concatenate(parts), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each run of ``width`` words inside one text, all in a row, and how many each text has."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : k + n]
    left = np.repeat(np.cumsum(counts), counts)[:n] - np.arange(n)
    return mixed(out[left >= width]), np.maximum(counts - width + 1, 0)


def by_text(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The values cut into one array for each text."""
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []
