import pytest
from pyspark.sql import functions as F

from panelrisk.operators import panel, ranks


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, "a", 0.5), (2, "a", None), (3, "a", 0.5), (4, None, 0.1), (5, None, 0.9), (6, None, None)]
    return spark.createDataFrame(rows, "id long, g string, s double")


def test_null_scores_keep_their_rows_without_a_rank(scored, rows):
    assert rows(ranks.percentile_rank(scored, "s"), "id", "rank_pct") == {(1, 2.5 / 4), (2, None), (3, 2.5 / 4), (4, 0.25), (5, 1.0), (6, None)}
    assert rows(ranks.with_ranks(scored, "s"), "id", "min_rank") == {(1, 2), (2, None), (3, 2), (4, 4), (5, 1), (6, None)}
    assert rows(ranks.ordinal_rank(scored, "s", "id"), "id", "ordinal") == {(1, 2), (2, None), (3, 3), (4, 4), (5, 1), (6, None)}
    assert rows(ranks.normalised_rank(scored, "s", "id", "r"), "id", "r") == {(1, 0.25), (2, None), (3, 0.5), (4, 0.0), (5, 0.75), (6, None)}
    assert rows(ranks.average_rank_columns(scored, ["s"], "id")) == {(1, 2.5), (2, None), (3, 2.5), (4, 1.0), (5, 4.0), (6, None)}
    assert rows(ranks.top_fraction(scored, "s", "id", 0.5), "id") == {(5,), (1,)}


def test_null_groups_are_a_group(scored, rows):
    assert rows(ranks.with_ranks(scored, "s", by=["g"]), "id", "min_rank") == {(1, 1), (2, None), (3, 1), (4, 2), (5, 1), (6, None)}
    assert rows(ranks.ordinal_rank(scored, "s", "id", by=["g"]), "id", "ordinal") == {(1, 1), (2, None), (3, 2), (4, 2), (5, 1), (6, None)}


@pytest.mark.parametrize("ranges", [2, 7, 300])
def test_any_number_of_ranges_gives_the_same(spark, ranges):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("s"))
    got = {r.id: r.ordinal for r in ranks.ordinal_rank(df, "s", "id", ranges=ranges, tie_ranges=3).collect()}
    want = {k: n for n, (_, k) in enumerate(sorted((-(k * 37 % 101), k) for k in range(500)), 1)}
    assert got == want


def test_a_day_given_twice_stops_the_job(spark):
    measures = spark.createDataFrame([(1, "2020-01-01", 1.0), (1, "2020-01-02", 2.0), (1, "2020-01-02", 1.5)], "cell int, day string, fwi double").withColumn("day", F.to_date("day"))
    arrays = panel.day_arrays(measures.filter("fwi <> 1.5"), {"fwi": F.col("fwi")}, "2020-01-01", "2020-01-03")
    assert arrays.first().fwi == [1.0, 2.0, None]
    with pytest.raises(Exception, match="several measures of one day"):
        panel.day_arrays(measures, {"fwi": F.col("fwi")}, "2020-01-01", "2020-01-03").collect()


def test_exact_quantiles_are_those_of_the_built_in_function(spark, rows):
    df = spark.range(701).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") * 37 % 101 / 7).alias("v"))
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    want = df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    got = {r.g: r.quantiles for r in ranks.exact_quantiles(df, "v", probs, by=["g"]).collect()}
    assert got == {r.g: r.q for r in want.collect()}
    whole = df.agg(F.percentile("v", F.array(*map(F.lit, probs)))).first()[0]
    assert ranks.exact_quantiles(df, "v", probs).first().quantiles == whole
    counted = df.groupBy("v").agg(F.count("*").alias("k"))
    assert ranks.exact_quantiles(counted, "v", probs, count="k").first().quantiles == whole
    assert ranks.exact_quantiles(df.limit(0), "v", [0.5]).first().quantiles == [None]


def test_column_quantiles_side_by_side(spark):
    import numpy as np
    from panelrisk.operators.ranks import column_quantiles

    rng = np.random.default_rng(4)
    rows = [(k % 3, None if k % 7 == 0 else float(rng.normal()), int(rng.integers(0, 4)), None) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, a double, b int, c double").repartition(5)
    whole = column_quantiles(df, ["a", "b", "c"], 0.5).first()
    assert whole.a == np.median([r[1] for r in rows if r[1] is not None]) and whole.b == np.median([r[2] for r in rows]) and whole.c is None
    for r in column_quantiles(df, ["a", "b"], 0.9, by=["g"]).collect():
        assert abs(r.a - np.quantile([x[1] for x in rows if x[0] == r.g and x[1] is not None], 0.9)) < 1e-12
    assert column_quantiles(df.limit(0), ["a"], 0.5).collect() == [(None,)]


def test_positives_without_a_score_count(spark):
    from panelrisk.operators.metrics import positives_rank_summary

    df = spark.createDataFrame([(0.9, 1), (None, 1), (0.5, 0), (0.4, 1)] + [(0.1, 0)] * 296, "score double, y int")
    assert tuple(positives_rank_summary(df, "score", "y").first()) == (2.0, 2 / 3, 3)
