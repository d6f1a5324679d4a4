import random

import pytest
from pyspark.sql import functions as F

from panelrisk.operators import compare, metrics, ranks


def sample(n, distinct, rate, seed=0):
    rng = random.Random(seed)
    return [(i, rng.randrange(distinct) / distinct, int(rng.random() < rate), 1 + rng.randrange(3)) for i in range(n)]


def brute_ap(rows):
    """Threshold by threshold, straight from the definition."""
    total = sum(y * w for _, _, y, w in rows)
    ap, before = 0.0, 0.0
    for t in sorted({s for _, s, _, _ in rows}, reverse=True):
        tp = sum(y * w for _, s, y, w in rows if s >= t)
        n = sum(w for _, s, _, w in rows if s >= t)
        ap += (tp / total - before) * tp / n
        before = tp / total
    return ap


@pytest.fixture(scope="module")
def data():
    return sample(2000, 60, 0.05)


@pytest.fixture(scope="module")
def frame(spark, data):
    # The hot score holds a third of the rows.
    return spark.createDataFrame(data, "key long, score double, y int, w int").withColumn(
        "score", F.when(F.col("key") % 3 == 0, 0.5).otherwise(F.col("score"))
    )


@pytest.fixture(scope="module")
def local(frame):
    return [tuple(r) for r in frame.collect()]


def test_average_precision_with_ties(frame, local):
    got = metrics.average_precision(metrics.score_groups(frame, "score", "y")).first()
    assert got.average_precision == pytest.approx(brute_ap([(k, s, y, 1) for k, s, y, _ in local]), abs=1e-12)


def test_weight_equals_copies(frame, local):
    weighted = metrics.average_precision(metrics.score_groups(frame, "score", "y", weight="w")).first()
    copies = frame.select("score", "y", F.explode(F.sequence(F.lit(1), F.col("w"))))
    repeated = metrics.average_precision(metrics.score_groups(copies, "score", "y")).first()
    assert weighted.average_precision == pytest.approx(repeated.average_precision, abs=1e-12)
    assert weighted.average_precision == pytest.approx(brute_ap(local), abs=1e-12)


@pytest.mark.parametrize("ranges", [2, 3, 17, 128])
def test_running_totals_do_not_depend_on_the_ranges(frame, ranges):
    groups = metrics.score_groups(frame, "score", "y")
    got = {r.score: r.cum_n for r in ranks.running_totals(groups, "score", ["n"], ranges=ranges).collect()}
    plain = {r.score: r.n for r in groups.collect()}
    assert got == {s: sum(n for t, n in plain.items() if t >= s) for s in plain}


def test_ordinal_rank_splits_a_hot_tie(frame, local):
    got = {r.key: r.ordinal for r in ranks.ordinal_rank(frame, "score", "key").collect()}
    order = sorted(local, key=lambda r: (-r[1], r[0]))
    assert got == {r[0]: i for i, r in enumerate(order, 1)}


def test_percentile_rank_averages_ties(frame, local):
    got = {r.key: r.rank_pct for r in ranks.percentile_rank(frame, "score").collect()}
    scores = [s for _, s, _, _ in local]
    for k, s, _, _ in local[:50]:
        below, same = sum(x < s for x in scores), sum(x == s for x in scores)
        assert got[k] == pytest.approx((below + (same + 1) / 2) / len(scores))


def test_no_ordered_window_over_all_rows(frame):
    plan = metrics.average_precision(metrics.score_groups(frame, "score", "y"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line and "score" in line]
    assert windows and all("_range" in line for line in windows)


def test_roc_auc(frame, local):
    pos = [s for _, s, y, _ in local if y]
    neg = [s for _, s, y, _ in local if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert metrics.roc_auc(frame, "score", "y").first().roc_auc == pytest.approx(wins / len(pos) / len(neg))


def test_budget_curve_ends_at_full_recall(frame):
    last = metrics.budget_curve(frame, "score", "y", "key").orderBy(F.desc("rows")).first()
    assert last.recall == pytest.approx(1.0) and last.budget == pytest.approx(1.0)


def test_no_positive_gives_null(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, y int")
    assert metrics.average_precision(metrics.score_groups(df, "score", "y")).first().average_precision is None


def test_alignment_ignores_order_and_refuses_damage(spark):
    a = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.9), (3, 0, 0.5)], "key int, y int, s double")
    shuffled = a.orderBy(F.desc("s"))
    out = compare.align_predictions({"a": (a, "s"), "b": (shuffled, "s")}, ["key"])
    assert out.filter("a <> b").count() == 0 and out.count() == 3
    for broken in (a.filter("key < 3"), a.withColumn("y", F.when(F.col("key") == 2, 0).otherwise(F.col("y")))):
        with pytest.raises(Exception, match="differ from the reference"):
            compare.align_predictions({"a": (a, "s"), "b": (broken, "s")}, ["key"]).collect()
    with pytest.raises(ValueError, match="lacks"):
        compare.align_predictions({"a": (a.drop("key"), "s")}, ["key"])


def test_bootstrap_is_deterministic_and_ordered(frame):
    rows = frame.withColumn("unit", F.col("key") % 40).withColumn("bad", -F.col("score")).withColumn("good", F.col("y") + F.col("score") / 10)
    runs = [compare.paired_bootstrap(rows, ["bad", "good"], "unit", replicas=30, seed=7).first() for _ in range(2)]
    assert runs[0] == runs[1]
    assert runs[0].low <= runs[0].gap_pct <= runs[0].high and runs[0].significant


def test_poisson_weights_have_mean_one(spark):
    u = compare.bootstrap_uniform(F.col("id"), F.lit(1), 42)
    row = spark.range(20000).select(compare.poisson_weight(u).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert row.m == pytest.approx(1, abs=0.03) and row.v == pytest.approx(1, abs=0.06)
