import random

import numpy as np
import pytest

from panelrisk.llm import hard_negatives as h
from panelrisk.llm import queries
from panelrisk.llm.vectors import packed, unpacked

FIELDS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def by_hand(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """(id, label, whole numbers) rows by two sorts for each anchor."""
    rows = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None and None not in v]
    dim = max((len(v) for *_, v in rows), default=0)
    rows = [(i, lab, [*v, *[0] * (dim - len(v))]) for i, lab, v in rows]
    anchors = {}
    for i, lab, v in rows:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for anchor, (label, vector) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, lab) for i, lab, v in rows if i != anchor)
        for minus, positive, lab in [s for s in scored if s[2] == label][:positives]:
            fit = [(n, i) for n, i, other in scored if other != label and low * -minus <= 100 * -n <= high * -minus]
            out += [(anchor, positive, k, i, -minus, -n) for k, (n, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*FIELDS).collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, vector array<long>, id string, key string").repartition(parts)


def mined(spark, rows, modulus=10, **kw):
    df = frame(spark, rows)
    return as_rows(h.hard_negatives(df, df.filter(f"vec_id % {modulus} = 0"), **kw))


def test_keys_sort_as_their_parts():
    rng = random.Random(1)
    rows = [(rng.choice([-5, 0, 3, 2**62, -(2**62)]), rng.randint(-3, 3), rng.randint(0, 1), rng.randint(-(2**63), 2**63 - 1)) for _ in range(300)]
    columns = [np.array(c, np.uint8 if k == 2 else np.int64) for k, c in enumerate(zip(*rows))]
    keys = packed(columns)
    assert [rows[k] for k in sorted(range(300), key=keys.__getitem__)] == sorted(rows)
    assert [c.tolist() for c in unpacked(keys, ["i8", "i8", "u1", "i8"])] == [c.tolist() for c in columns]


@pytest.mark.parametrize("positive", [-70, -1, 0, 1, 9, 10, 11, 333])
def test_window_holds_what_the_rule_says(positive):
    low, high = h.window_of(positive, 30, 90)
    assert [s for s in range(-100, 400) if 30 * positive <= 100 * s <= 90 * positive] == list(range(low, high + 1))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force_with_ties_copies_and_a_hot_label(spark, monkeypatch, seed):
    monkeypatch.setattr(h, "ANCHOR_BYTES", 8 * 6 * 8)
    monkeypatch.setattr(h, "SCORES", 100)
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.randint(-2, 3) for _ in range(4)]) for i in range(-60, 200)]
    rows += [(1000 + i, rng.choice([0, 1]), [2, 2, 2, 2]) for i in range(150)]
    rows += [(5, 1, [1, 1, 1, 1]), (5, 1, [1, 1, 1, 1]), (20, 2, [3, 0, 1, 1]), (1010, 1, [0, 0, 0, 0])]
    assert mined(spark, rows) == by_hand(rows, lambda i: i % 10 == 0)


def test_scores_of_zero_and_below(spark):
    rows = [(0, 1, [1, 0]), (1, 1, [0, 1]), (2, 1, [-1, 0]), (3, 2, [0, 5]), (4, 2, [0, -5]), (5, 2, [-1, 0]), (6, 3, [0, 0])]
    found = mined(spark, rows)
    assert found == by_hand(rows, lambda i: i % 10 == 0)
    assert [(r[1], r[3]) for r in found] == [(1, 3), (1, 4), (1, 6)]


def test_odd_rows_take_no_part(spark):
    rows = [
        (0, 1, [10, 10]), (1, 1, [8, 8]), (2, 2, [5, 5]), (None, 1, [9, 9]), (3, None, [9, 9]), (4, 1, None), (5, 1, [9, None]), (6, 2, [3]), (7, 2, []), (10, 1, [10, 10]), (10, 1, [10, 10]),
        (20, 7, [1, 1]),
    ]
    assert mined(spark, rows) == by_hand(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, positives=1, negatives=1) == by_hand(rows, lambda i: i % 10 == 0, 1, 1)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, [(0, 1, [1])], modulus=7) == []
    df = frame(spark, [(1, 1, [1]), (2, 2, [3])])
    assert as_rows(h.hard_negatives(df, df.limit(0))) == []
    assert as_rows(h.hard_negatives(df.limit(0), df.limit(0))) == []


def test_large_numbers_are_exact_or_refused():
    a = np.array([[2**30, 3]]), np.array([[2**30, 5], [-(2**30), 7]])
    assert h.scores(*a).tolist() == [[2**60 + 15, -(2**60) + 21]]
    with pytest.raises(OverflowError):
        h.scores(np.array([[2**40]]), np.array([[2**40]]))


def test_query_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [int(np.floor(256 * float(x))) for x in r["embedding"]]) for r in table]
    found = as_rows(queries.op11_hard_negatives(spark, sf_dir))
    assert found and found == by_hand(rows, lambda i: i % 100 == 0)


def test_query_on_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.4, 0.5]), (2, 2, [0.2, nan]), (3, 2, [0.2, inf]), (4, 2, [0.2, None]), (5, 2, None), (6, None, [0.2, 0.2]), (8, 1, [0.2, 0.21]), (7, 1, [0.3, 0.5]), (14, 9, [0.3, 0.25])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = [(0, 2, [128, 128]), (1, 1, [102, 128]), (8, 1, [51, 53]), (7, 2, [76, 128]), (14, 0, [76, 64])]
    assert as_rows(queries.op11_hard_negatives(spark, str(tmp_path))) == by_hand(kept, lambda i: i % 100 == 0)
