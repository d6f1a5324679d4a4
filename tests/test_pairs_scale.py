"""Pairs of places: entities are moved, pairs never, and the check of both directions counts them where they are."""
import random

import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import checks, geo


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lost(df):
    return df.filter(~((F.col("entity") % 5 == 0) & (F.col("entity") < F.col("neighbour"))))


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(17)
    rows = [(k, 45 + 0.9 * rng.random(), 179.2 + 1.4 * rng.random()) for k in range(150)]
    rows = [(k, lat, lon - 360 if lon > 180 else lon) for k, lat, lon in rows] + [(500 + k, 45.3, 179.9) for k in range(25)]
    rows += [rows[3], (4, 45.31, 179.91), (None, 45.0, 179.5), (900, None, 179.5)]
    return spark.createDataFrame(rows, "entity long, lat double, lon double").cache()


@pytest.mark.parametrize("block", [4, 16384])
def test_an_entity_is_moved_to_nine_squares_however_dense(spark, points, monkeypatch, block):
    """Before, a dense square was cut into leaves, each visited by all that were within reach: more, the denser."""
    monkeypatch.setattr(geo, "ROWS_PER_BLOCK", block)
    got = sorted(tuple(r) for r in geo.pairs_within(points, 20.0).select("entity", "neighbour", F.round("dist_m", 3)).collect())
    other = points.select(F.col("entity").alias("neighbour"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    same = (F.col("lat") == F.col("lat2")) & (F.col("lon") == F.col("lon2"))
    dist = F.when(same, 0.0).otherwise(geo.great_circle_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    want = points.crossJoin(other).filter("entity <> neighbour").filter(dist <= 20000.0)
    assert got == sorted(tuple(r) for r in want.select("entity", "neighbour", F.round(dist, 3)).collect()) and len(got) > 2000


def test_moved_rows_grow_with_the_points_only(spark):
    """A hundred times the points in one place: each is still moved as often. Before, dense squares had more visitors."""
    moved = []
    for n in (40, 4000):
        rng = random.Random(1)
        df = spark.createDataFrame([(k, 45 + rng.random() / 3, 2 + rng.random() / 3) for k in range(n)], "entity long, lat double, lon double")
        pairs = geo.pairs_within(df, 50.0)
        plan = pairs._jdf.queryExecution().optimizedPlan()
        repartitions = []

        def walk(node):
            if node.nodeName() == "RepartitionByExpression":
                repartitions.append(node)
            else:
                children = node.children()
                for k in range(children.size()):
                    walk(children.apply(k))

        walk(plan)
        rows = sum(DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node), spark).count() for node in repartitions)
        moved.append(rows / n)
    assert moved[0] <= 20 and moved[1] <= 20


def test_symmetry_is_counted_without_moving_pairs(spark, points):
    """Before, every pair of both tables was shuffled."""
    pairs = geo.pairs_within(points, 20.0, tiled=True)
    for df in (pairs, lost(pairs), pairs.filter("entity <> 7 OR neighbour < 50")):
        got, want = checks.pairs_symmetric(df), checks.pairs_symmetric(df.drop("tile"))
        assert [r["value"] for r in got.collect()] == [r["value"] for r in want.collect()]
        above = plan_of(got).partition("MapInPandas")
        assert above[1] and above[0].count("Exchange") <= 1 and "SinglePartition" in above[0]
    assert checks.pairs_symmetric(lost(pairs)).first()["value"] > 100 and checks.pairs_symmetric(pairs).first()["value"] == 0


@pytest.mark.parametrize("held", [0, 3, 1 << 20])
@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_mirrors_far_apart_and_in_any_batch(monkeypatch, held, size):
    monkeypatch.setattr(checks, "HELD_PAIRS", held)
    rng = random.Random(held + size)
    rows, want = [], 0
    for tile in (3, 1, 2):
        own = []
        for k in range(40):
            a, b = 2 * k + 1000 * tile, 2 * k + 1 + 1000 * tile
            kind = rng.randrange(3)
            own += [(tile, a, b)] + ([(tile, b, a)] if kind else [])
            want += not kind
        rng.shuffle(own) if tile > 1 else None
        rows += own + [(tile, 7, 7), (tile, None, 5)]
        want += 1
    df = pd.DataFrame(rows, columns=["tile", "entity", "neighbour"]).astype({"entity": "float"})
    found = list(checks._unmirrored(df.iloc[k : k + size] for k in range(0, len(df), size)))
    assert sum(f["c"].sum() for f in found) == want
    with pytest.raises(ValueError, match="one after the other"):
        list(checks._unmirrored(iter([df.iloc[[0, 80, 1]].assign(tile=[1, 2, 1])])))


def test_symmetry_of_no_pairs(spark):
    none = spark.createDataFrame([], "tile long, entity long, neighbour long")
    assert checks.pairs_symmetric(none).first()["value"] == 0


def test_only_places_with_events_visit_and_nine_squares_at_most(spark):
    """Before, dense squares were split, so a place with its events was moved to more of them the denser they were."""
    rng = random.Random(4)
    points = spark.createDataFrame([(k, 45 + rng.random() / 5, 2 + rng.random() / 5) for k in range(6000)], "entity long, lat double, lon double")
    days = spark.range(50).selectExpr("id AS entity", "DATE '2008-01-02' AS day", "2L AS n")
    moved = []
    inner = geo.spread

    def counted(df, *keys):
        if "_home" in df.columns:
            moved.append({r["_home"]: r["count"] for r in df.groupBy("_home").count().collect()})
        return inner(df, *keys)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(geo, "spread", counted)
        geo.neighbour_features(days, points, 50.0)
    [rows] = moved
    assert rows[True] == 6000 and 0 < rows[False] <= 9 * 50
