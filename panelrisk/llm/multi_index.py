"""Nearest neighbours by an inverted multi-index: the halves of a vector are quantised apart.

Each half has its own few centroids; a cell is a pair of them. A query visits cells in order of the summed squared
distances of its halves to the pair, which a heap gives one by one, until enough rows stand in the visited cells; these
rows are reranked by their exact distance. Every row is in the index; only the centroids are fitted on a sample.

Neighbouring cells share a slice of the index, and a cell of many rows is dealt over several slices, so a slice is
bounded whatever the cells hold. Queries are sent to the slices that have cells they visit. In a task, a slice's rows
come first and the queries pass them in batches; each query leaves the slice with its nearest rows only.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written
from .vectors import is_usable, matrix, width

#: Rows that the centroids are fitted on, at most: those of the least hashes.
TRAIN_ROWS = 20_000
#: Centroids of each half, at most.
CENTROIDS = 64
ROUNDS = 12
#: A query visits cells until they hold this part of all rows, and this many rows at least. Vectors without any
#: structure need this much for 0.9 of their neighbours; a corpus with clusters does with far less.
SHARE = 0.6
LEAST_VISITED = 1000
#: Rows of a slice: enough slices for every task, each small enough to be held.
SLICE_ROWS = (256, 32_768)
#: Distances that a task computes at a time.
PAIRS = 1 << 21


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid next to each row."""
    with np.errstate(all="ignore"):
        return np.argmin((centroids**2).sum(1) - 2 * rows @ centroids.T, axis=1)


def fitted(rows: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """Centroids of the rows by Lloyd's rounds, begun at different rows."""
    different = np.unique(rows, axis=0)
    centroids = different[np.random.default_rng(seed).permutation(len(different))[:count]].copy()
    for _ in range(ROUNDS):
        owner = _nearest(rows, centroids)
        counts = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, rows)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the first and of the second half, and how the cells are dealt to slices."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    slices: np.ndarray
    parts: np.ndarray

    def cells(self, rows: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return _nearest(rows[:, :half], self.first) * len(self.second) + _nearest(rows[:, half:], self.second)

    def visited(self, query: np.ndarray, enough: float) -> list[int]:
        """Cells in order of summed distance, until they hold enough rows; cells without rows are passed over."""
        half = self.first.shape[1]
        a, b = ((query[:half] - self.first) ** 2).sum(1), ((query[half:] - self.second) ** 2).sum(1)
        a_order, b_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[a_order].tolist(), b[b_order].tolist()
        counts = self.counts.reshape(len(a), len(b))[np.ix_(a_order, b_order)].tolist()
        out, held = [], 0
        # The row of pairs of a centroid is opened when the row above it is, and then read from its nearest partner on.
        heap = [(a[0] + b[0], 0, 0)]
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            if counts[i][j]:
                held += counts[i][j]
                out.append(int(a_order[i]) * len(b) + int(b_order[j]))
        return out


def dealt(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its slice and over how many slices, from that one on, it is dealt."""
    slices, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    at, room = 0, size
    for cell, count in enumerate(counts.tolist()):
        if count > room:
            if room < size:
                at, room = at + 1, size
            if count > size:
                slices[cell], parts[cell] = at, -(-count // size)
                at += int(parts[cell])
                continue
        slices[cell] = at
        room -= count
    return slices, parts


@dataclass(frozen=True)
class Index:
    """The written rows (slice, cell, id, vector) with the codebooks they were made by."""

    rows: DataFrame
    codebooks: Codebooks
    dim: int
    total: int


def _usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    df = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return df.filter(F.col("id").isNotNull() & is_usable("vector") & F.exists("vector", lambda x: x != 0))


def build(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> Index:
    """Index every usable row. Shorter vectors count as filled up with zeros."""
    spark = df.sparkSession
    rows = _usable(df, id_column, vector)
    dim = width(rows, "vector")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).select("vector").toArrow()
    trained = matrix(sample.column(0), dim, np.float64) if sample.num_rows else np.zeros((1, dim))
    count = max(1, min(CENTROIDS, isqrt(2 * len(trained))))
    half = dim // 2
    books = Codebooks(fitted(trained[:, :half], count), fitted(trained[:, half:], count), *[np.zeros(0, np.int64)] * 3)
    cells = len(books.first) * len(books.second)
    found = rows.mapInArrow(_cells_of(spark.sparkContext.broadcast(books), dim), "cell int").groupBy("cell").count().collect()  # a row for each cell
    counts = np.zeros(cells, np.int64)
    for row in found:
        counts[row["cell"]] = row["count"]
    total = int(counts.sum())
    width_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(max(SLICE_ROWS[0], total // (4 * width_)), SLICE_ROWS[1])
    books = Codebooks(books.first, books.second, counts, *dealt(counts, size))
    placed = rows.mapInArrow(_placed(spark.sparkContext.broadcast(books), dim), "slice int, cell int, id long, vector array<double>")
    return Index(written(placed, "multi-index"), books, dim, total)


def _cells_of(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.cells(matrix(batch.column("vector"), dim, np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32))], ["cell"])

    return run


def _placed(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, at = shared.value, TaskContext.get().partitionId()
        for batch in batches:
            cells = books.cells(matrix(batch.column("vector"), dim, np.float64))
            turn = np.arange(at, at + len(cells))  # the rows of a large cell take turns
            at += len(cells)
            slices = books.slices[cells] + turn % books.parts[cells]
            yield pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int32)), pa.array(cells.astype(np.int32)), batch.column("id"), batch.column("vector")], ["slice", "cell", "id", "vector"])

    return run


_PROBE = "slice int, kind int, cells array<int>, id long, vector array<double>"


def _probes(shared, indexed: int, dim: int, total: int, share: float, least: int):
    """Each query once for every slice that has a cell it visits, with those cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            queries = matrix(batch.column("vector"), dim, np.float64)[:, :indexed]
            for k, (query, own) in enumerate(zip(queries, batch.column("own").to_pylist())):
                by_slice: dict[int, list[int]] = {}
                for cell in books.visited(query, max(share * total, least) + own):
                    for part in range(books.parts[cell]):
                        by_slice.setdefault(int(books.slices[cell]) + part, []).append(cell)
                n = len(by_slice)
                if not n:
                    continue
                one = [batch.column(c).slice(k, 1) for c in ("id", "vector")]
                ids, vectors = (pa.concat_arrays([c] * n) for c in one)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(by_slice), pa.int32()), pa.array([1] * n, pa.int32()), pa.array(list(by_slice.values()), pa.list_(pa.int32())), ids, vectors],
                    ["slice", "kind", "cells", "id", "vector"],
                )

    return run


class _Slice:
    """The rows of a slice in order of cells."""

    def __init__(self, cells: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(cells, kind="stable")
        self.cells, self.ids, self.rows = cells[order], ids[order], rows[order]
        self.squares = (self.rows**2).sum(1)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, visited: list[list[int]], k: int) -> list[tuple[np.ndarray, ...]]:
        """(query, id, distance) of the k nearest rows in the visited cells of each query, exact."""
        out = []
        different, owner = np.unique(self.cells, return_inverse=True)
        step = max(1, PAIRS // len(self.ids))
        for i in range(0, len(ids), step):
            part = queries[i : i + step]
            open_ = np.zeros((len(part), len(different)), bool)
            for n, cells in enumerate(visited[i : i + step]):
                open_[n, np.searchsorted(different, cells)] = True
            with np.errstate(all="ignore"):
                squares = (part**2).sum(1)
                near = squares[:, None] + self.squares - 2 * part @ self.rows.T
                slack = 1e-12 * part.shape[1] * (squares + self.squares.max())
            passed = ~open_[:, owner] | (ids[i : i + step, None] == self.ids)
            unknown = ~np.isfinite(near) & ~passed  # components too large to square
            near[passed | unknown] = np.inf
            for n, line in enumerate(near):
                last = np.partition(line, k - 1)[k - 1] if len(line) > k else np.inf
                # What may be among the nearest, with room for rounding, is measured on the vectors themselves.
                taken = np.flatnonzero(unknown[n] | ((line <= last + np.nan_to_num(slack[n])) & (line < np.inf)))
                exact = distances(part[n], self.rows[taken])
                order = np.lexsort((self.ids[taken], exact))[:k]
                out.append((np.full(len(order), ids[i + n]), self.ids[taken][order], exact[order]))
        return out


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles, squares added from the first component to the last."""
    if not rows.size:
        return np.zeros(len(rows))
    with np.errstate(all="ignore"):
        return np.sqrt(np.cumsum((rows - query) ** 2, axis=1)[:, -1])


def _reranked(dim: int, k: int):
    """Reads a slice's rows (kind 0), then the queries sent to it (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = -1, [], None
        for batch in batches:
            slices, kinds = batch.column("slice").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, (slices[1:] != slices[:-1]) | (kinds[1:] != kinds[:-1])]) if len(slices) else []
            out = []
            for i, j in zip(edges, [*edges[1:], len(slices)]):
                rows = batch.slice(int(i), int(j - i))
                ids, vectors = rows.column("id").to_numpy(), matrix(rows.column("vector"), dim, np.float64)
                if slices[i] != number:
                    number, parts, held = slices[i], [], None
                if kinds[i] == 0:
                    parts.append((rows.column("cells").flatten().to_numpy(), ids, vectors))
                elif parts:
                    held = held or _Slice(*(np.concatenate(c) for c in zip(*parts)))
                    out += held.nearest(ids, vectors, rows.column("cells").to_pylist(), k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return run


def search(index: Index, queries: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 10, share: float = SHARE, least: int = LEAST_VISITED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query, under another id than its own.

    score is the Euclidean distance of the vectors as they are, in doubles; ties go to the smaller id. Rows and queries
    without an id or vector, with a null or non-finite component, or all zero take no part; an empty index or no query
    gives no row. A repeated row stands as often as it is there; a repeated query id is searched once, with its least
    vector. All rows are visited by queries that ``least`` covers, so fewer than ``k`` rows are all returned.
    """
    spark = index.rows.sparkSession
    given = _usable(queries, id_column, vector).groupBy("id").agg(F.min("vector").alias("vector"), F.count("*").alias("own"))
    shared, dim = spark.sparkContext.broadcast(index.codebooks), max(index.dim, width(given, "vector"))
    probes = given.select("id", "vector", "own").mapInArrow(_probes(shared, index.dim, dim, index.total, share, least), _PROBE)
    entries = index.rows.select("slice", F.lit(0).alias("kind"), F.array("cell").alias("cells"), "id", "vector")
    both = entries.unionByName(probes).repartition("slice").sortWithinPartitions("slice", "kind")
    near = both.mapInArrow(_reranked(dim, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """Build an index of ``df``, search it once and drop it."""
    index = build(df, id_column, vector)
    found = written(search(index, queries, id_column, vector, k), "neighbours")
    forget(index.rows)
    return found
