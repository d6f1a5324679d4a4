import random

import numpy as np
import pytest

from panelrisk.llm import multi_index as m
from panelrisk.llm import queries


def by_hand(rows, is_query, k=10):
    """(id, vector) rows: the k nearest of each query by full sort."""
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max((len(v) for _, v in rows), default=0)
    rows = [(i, np.array([*v, *[0.0] * (dim - len(v))])) for i, v in rows]
    given = {}
    for i, v in rows:
        if is_query(i) and (i not in given or tuple(v) < tuple(given[i])):
            given[i] = v
    out = []
    for q, v in given.items():
        near = sorted((float(m.distances(v, r[None])[0]), i) for i, r in rows if i != q)[:k]
        out += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, slice string, cell int").repartition(parts)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def recall(found, exact):
    hits = {(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in exact}
    return len(hits) / max(1, len(exact))


@pytest.fixture(scope="module")
def books():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(3000, 7))
    first, second = m.fitted(rows[:, :3], 9), m.fitted(rows[:, 3:], 11)
    cells = m.Codebooks(first, second, np.zeros(0), np.zeros(0), np.zeros(0)).cells(rows)
    return m.Codebooks(first, second, np.bincount(cells, minlength=99), np.zeros(99, int), np.ones(99, int)), rows


def test_cells_are_visited_in_order_of_summed_distance(books):
    books, rows = books
    for query in rows[:20]:
        summed = [((query[:3] - a) ** 2).sum() + ((query[3:] - b) ** 2).sum() for a in books.first for b in books.second]
        every = books.visited(query, np.inf)
        assert sorted(every) == np.flatnonzero(books.counts).tolist()
        assert np.all(np.diff([summed[c] for c in every]) >= 0)
        some = books.visited(query, 700)
        assert some == every[: len(some)] and books.counts[some].sum() >= 700 > books.counts[some[:-1]].sum()


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_slices_are_bounded_and_hold_every_cell(size):
    counts = np.array([0, 3, 5, 200, 0, 1, 1, 49, 50, 51, 7, 7, 7])
    slices, parts = m.dealt(counts, size)
    held = {}
    for cell, count in enumerate(counts):
        for turn in range(count):
            held.setdefault(slices[cell] + turn % parts[cell], []).append(cell)
    assert max(map(len, held.values())) <= size and sum(map(len, held.values())) == counts.sum()


def test_all_rows_are_visited_by_a_full_share(spark, monkeypatch):
    """With every cell visited the result is exact: ties, copies under many ids, hot cells over several slices."""
    monkeypatch.setattr(m, "SLICE_ROWS", (16, 16))
    monkeypatch.setattr(m, "PAIRS", 64)
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(5)]) for i in range(-30, 300)] + [(1000 + i, [1.0] * 5) for i in range(120)]
    rows += [(3, [9.0] * 5), (20, [1.0] * 5), (20, [1.0] * 5)]
    df = frame(spark, rows)
    index = m.build(df)
    assert index.codebooks.parts.max() > 3 and index.total == len([r for r in rows if any(r[1])])
    found = as_rows(m.search(index, df.filter("vec_id % 10 = 0"), share=1.0))
    assert found == by_hand(rows, lambda i: i % 10 == 0)


def test_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 32)))]
    df = frame(spark, rows)
    found = as_rows(m.nearest(df, df.filter("vec_id % 100 = 0")))
    exact = by_hand(rows, lambda i: i % 100 == 0)
    assert len(found) == len(exact) and recall(found, exact) >= 0.9
    true = {(q, i): d for q, _, i, d in by_hand(rows, lambda i: i % 100 == 0, 4000)}
    assert all(true[q, i] == d for q, _, i, d in found)
    assert [r[:2] for r in found] == [r[:2] for r in exact]


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (None, [1.0, 1.0]), (8, [3.0]), (10, None), (20, [0.0]), (30, [5.0, 5.0]), (40, [1.0, 2.0])]
    df = frame(spark, rows)
    found = as_rows(m.nearest(df, df.filter("vec_id % 10 = 0")))
    assert found == by_hand(rows, lambda i: i % 10 == 0) and {r[0] for r in found} == {0, 30, 40}


def test_very_large_components(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 1.0]), (3, [1.0, 1.0])]
    df = frame(spark, rows)
    assert as_rows(m.nearest(df, df.filter("vec_id = 0"))) == [(0, 1, 1, 1.0), (0, 2, 2, float("inf")), (0, 3, 3, float("inf"))]


def test_no_rows_and_no_queries(spark):
    df = frame(spark, [(1, [1.0]), (2, [2.0])])
    assert as_rows(m.nearest(df, df.limit(0))) == []
    assert as_rows(m.nearest(df.limit(0), df)) == []
    assert as_rows(m.nearest(df.filter("vec_id = 1"), df.filter("vec_id = 1"))) == []


def test_query_recall(spark, sf_dir):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found, exact = as_rows(queries.op12_multi_index(spark, sf_dir)), by_hand(rows, lambda i: i % 100 == 0)
    assert len(found) == len(exact) and recall(found, exact) >= 0.9
