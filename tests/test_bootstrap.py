"""The bootstrap against its definition, with the rows cut into batches at every place."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelrisk.operators import compare


def weights(spark, units, replicas):
    draw = [compare.poisson_weight(compare.bootstrap_uniform(F.col("unit"), F.lit(r), 42)).alias(f"r{r}") for r in range(1, replicas + 1)]
    rows = spark.createDataFrame([(u,) for u in units], "unit long").select("unit", *draw).collect()
    return {r["unit"]: [r[f"r{k}"] for k in range(1, replicas + 1)] for r in rows}


def average_precision(rows):
    """(score, y, weight) rows: the sum over scores of recall step times precision."""
    n = pos = value = 0
    total = sum(y * w for _, y, w in rows)
    for score in sorted({s for s, _, _ in rows}, reverse=True):
        own = [(y, w) for s, y, w in rows if s == score]
        n, step = n + sum(w for _, w in own), sum(y * w for y, w in own)
        pos += step
        value += step * pos / n if n else 0
    return value / total if total else None


@pytest.mark.parametrize("batch", [3, 50, 10_000])
def test_replicas_against_the_definition(spark, batch, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 8), int(rng.random() < 0.3), rng.choice([0.1, 0.2, 0.5, rng.random()]), 0.5, None if k % 9 == 0 else rng.random()) for k in range(400)]
    spark.createDataFrame(rows, "id long, unit long, y int, a double, constant double, holes double").write.parquet(f"{tmp_path}/aligned")
    aligned = spark.read.parquet(f"{tmp_path}/aligned").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {(r["replica"], r["model"]): r["average_precision"] for r in compare.bootstrap_scores(aligned, ["a", "constant", "holes"], "unit", 6).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    draws = weights(spark, range(9), 6)
    assert len(found) == 18
    for (replica, model), value in found.items():
        column = ["a", "constant", "holes"].index(model) + 3
        own = [(r[column], r[2], draws[r[1]][replica - 1]) for r in rows if r[column] is not None]
        assert value == pytest.approx(average_precision(own), rel=1e-12)


def frame(rows):
    return pd.DataFrame(rows, columns=["model", "_range", "score", "n", "pos", "_w", "_n", "_pos"])


@pytest.mark.parametrize("tied", [1, 2, 1000])
def test_rows_cut_at_every_place(monkeypatch, tied):
    """Wherever a batch ends, also inside a tie and after a range's first row, the parts are the same."""
    monkeypatch.setattr(compare, "TIED", tied)
    rng = np.random.default_rng(1)
    raw = [("m", r, s, int(rng.integers(1, 4)), 1, rng.integers(0, 3, 4).astype(np.int8)) for r, scores in ((1, [0.9, 0.9, 0.9, 0.8]), (0, [0.4, 0.4, 0.3])) for s in scores]
    given = pd.DataFrame(raw, columns=["model", "_range", "score", "n", "pos", "_w"])
    rows = pd.concat([b for b in compare._tied_added_up(iter([given])) if len(b)])
    rows = rows[frame([]).columns].sort_values(["model", "_range", "score"], ascending=[True, False, False], kind="stable").reset_index(drop=True)
    before, positives = compare._before(pd.concat(list(compare._range_totals(iter([rows])))))
    assert positives["m"].tolist() == sum(np.asarray(r[5], int) for r in raw).tolist()
    expected = [average_precision([(r[2], y, int(r[5][k])) for r in raw for y in [1] + [0] * (r[3] - 1)]) for k in range(4)]
    for cut in range(len(rows) + 1):
        for other in range(cut, len(rows) + 1):
            batches = [b for b in (rows[:cut], rows[cut:other], rows[other:])]
            parts = pd.concat([p for p in compare._range_parts(before)(iter([b for b in batches if len(b)]))])
            sums = parts.groupby("replica")["part"].sum().to_numpy()
            assert sums / np.maximum(positives["m"], 1) == pytest.approx([e or 0 for e in expected])


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "id long, unit long, y int, a double, b double").write.parquet(f"{tmp_path}/aligned")
    aligned = spark.read.parquet(f"{tmp_path}/aligned")
    assert compare.bootstrap_scores(aligned, ["a", "b"], "unit", 3).collect() == []


def test_weights_are_one_byte_for_each_replica():
    """Before, a row's weights were an array, which was taken apart and put together row by row."""
    part = frame([("m", 0, 0.5, 2, 1, bytes([0, 1, 9]), [], []), ("m", 0, 0.4, 0, 0, b"", [3, 4, 5], [1, 0, 2])])
    n, pos = compare._weighted(part)
    assert n.tolist() == [[0, 2, 18], [3, 4, 5]] and pos.tolist() == [[0, 1, 9], [1, 0, 2]]
