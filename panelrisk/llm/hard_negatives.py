"""Hard negatives by secondary sort: scores packed into keys that sort as (anchor, score from high to low, id).

Anchors are taken in blocks whose bytes are bounded; a block goes to every task, and all rows pass it where they lie:

1. each task keeps an anchor's first rows of its own label, and of those of all tasks the first ones are its positives;
2. a positive opens a window of scores. Each task keeps the first rows of other labels in each window - whatever is
   among the first of all rows is among the first of its task - and packs them into keys, and the positives too;
3. the keys are dealt by anchor and sorted inside the partitions. One pass over them reads an anchor from high to low:
   a positive opens its window, a negative goes to the windows that are open for it, a full or passed window closes.
   No anchor is gathered: what is held are its open windows.

Neither vectors nor rows are shuffled, only keys that may be in the result.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, written
from .vectors import is_usable, matrix, packed, unpacked, width

#: Bytes of the anchors that a task holds at a time; they are dealt to blocks by hash, so about this many.
ANCHOR_BYTES = 1 << 23
#: Scores that a task computes at a time.
SCORES = 1 << 21

_CANDIDATE = "key binary"
_FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; in doubles where no sum can leave their whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    raise OverflowError("inner products of these vectors do not fit a long")


def _rows(batches: Iterator[pa.RecordBatch], dim: int, anchors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) in order of ids, so many at a time that the scores with all anchors are bounded."""
    step = max(1, SCORES // max(1, anchors))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            ids, labels = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            yield ids[order], labels[order], matrix(part.column(2), dim, np.int64)[order]


def _first_positives(block, dim: int, count: int):
    """The first ``count`` rows of an anchor's label among the rows of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, vectors = block.value
        for ids, own, rows in _rows(batches, dim, len(anchors)):
            out = []
            for label in np.unique(own):
                a, r = np.flatnonzero(labels == label), np.flatnonzero(own == label)
                found = scores(vectors[a], rows[r])
                for k, line in zip(a, found):
                    order = np.argsort(-line, kind="stable")  # ids are in order already
                    order = order[ids[r][order] != anchors[k]][:count]
                    out.append((np.full(len(order), anchors[k]), ids[r][order], line[order]))
            if out:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "positive_score"])

    return run


def _in_windows(block, dim: int, count: int):
    """Packed keys of the first ``count`` rows of other labels in each window, among the rows of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, vectors, windows = block.value
        for ids, own, rows in _rows(batches, dim, len(anchors)):
            lines = scores(vectors, rows)
            out = []
            for k, line in enumerate(lines):
                spans = windows[k]
                if not spans:
                    continue
                low = min(lo for lo, _ in spans)
                places = np.flatnonzero((own != labels[k]) & (line >= low) & (line <= max(hi for _, hi in spans)))
                places = places[np.argsort(-line[places], kind="stable")]  # ids are in order already
                from_high = -line[places]
                kept = np.zeros(len(places), bool)
                for lo, hi in spans:
                    begin = np.searchsorted(from_high, -hi)
                    kept[begin : min(np.searchsorted(from_high, -lo, side="right"), begin + count)] = True
                places = places[kept]
                if len(places):
                    out.append((np.full(len(places), anchors[k]), -line[places], ids[places]))
            if out:
                anchor, minus, negative = (np.concatenate(c) for c in zip(*out))
                keys = packed([anchor, minus, np.ones(len(anchor), np.uint8), negative.astype(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])

    return run


def _pack_positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        anchor, positive, score = (batch[c].to_numpy(np.int64) for c in ("anchor_id", "positive_id", "positive_score"))
        yield pd.DataFrame({"key": packed([anchor, -score, np.zeros(len(batch), np.uint8), positive])})


def window_of(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * positive <= 100 * s <= high * positive, as whole numbers from and to."""
    return -((-low * positive_score) // 100), (high * positive_score) // 100


def _emit(low: int, high: int, count: int):
    """Reads sorted keys; of a score, positives come before negatives, so a window is open when its first row comes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, windows = None, []
        for batch in batches:
            if not len(batch):
                continue
            out = []
            for this, minus, negative, row in zip(*(c.tolist() for c in unpacked(batch["key"].tolist(), ["i8", "i8", "u1", "i8"]))):
                if this != anchor:
                    anchor, windows = this, []
                if not negative:
                    windows.append([row, -minus, *window_of(-minus, low, high), 0])
                    continue
                closed = False
                for window in windows:
                    if window[2] <= -minus <= window[3] and window[4] < count:
                        window[4] += 1
                        out.append((anchor, window[0], window[4], row, window[1], -minus))
                    closed |= window[4] >= count or -minus < window[2]
                if closed:
                    windows = [w for w in windows if w[4] < count and -minus >= w[2]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, id_column: str = "vec_id", vector: str = "vector", label: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    ``vector`` holds whole numbers (array<long>), ``id_column`` and ``label`` are whole numbers. A score is an inner
    product; higher scores come first, of equal ones the smaller id. An anchor's positives are its first rows of the
    same label under another id; a positive's negatives are the first rows of other labels whose score is from ``low``
    to ``high`` percent of the positive's.

    Rows without id, label or vector take no part, nor do vectors with a null component; an empty table gives no row.
    Shorter vectors count as filled up with zeros. A repeated row counts as often as it stands there; an anchor id that
    is repeated is searched once, with its least label and vector. Other columns are not read. A score beyond a long
    stops the job.
    """
    spark = rows.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<long>").alias("vector"))
        return df.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & is_usable("vector"))

    table, given = usable(rows), usable(anchors)
    dim = width(table.unionByName(given).select("vector"), "vector")
    at_a_time = max(1, ANCHOR_BYTES // (8 * (dim + 2)))
    least = given.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.label", "a.vector")
    total = least.count()
    parts = max(1, -(-total // at_a_time))
    dealt = written(least.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition("block"), "anchors")
    found = []
    for part in range(parts):
        block = dealt.filter(F.col("block") == part).select("id", "label", "vector").toArrow()
        ids, labels = (block.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        vectors = matrix(block.column("vector"), dim, np.int64) if len(ids) else np.zeros((0, dim), np.int64)
        near = _positives(spark, table, ids, labels, vectors, dim, positives)
        spans: list[list[tuple[int, int]]] = [[] for _ in ids]
        place = {int(i): k for k, i in enumerate(ids)}
        for row in near.toLocalIterator():
            spans[place[row["anchor_id"]]].append(window_of(row["positive_score"], low, high))
        held = spark.sparkContext.broadcast((ids, labels, vectors, spans))
        keys = table.mapInArrow(_in_windows(held, dim, negatives), _CANDIDATE).unionByName(near.mapInPandas(_pack_positives, _CANDIDATE))
        sorted_keys = keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")
        found.append(written(sorted_keys.mapInPandas(_emit(low, high, negatives), _FOUND), "negatives"))
        forget(near)
    forget(dealt)
    return reduce(DataFrame.unionByName, found)


def _positives(spark: SparkSession, table: DataFrame, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, dim: int, count: int) -> DataFrame:
    """Written rows (anchor_id, positive_id, positive_score): the first ones of each anchor of the block."""
    held = spark.sparkContext.broadcast((ids, labels, vectors))
    best = table.mapInArrow(_first_positives(held, dim, count), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return written(best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= count).drop("n"), "positives")
