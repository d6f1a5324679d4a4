import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrisk.operators import codes, geo

MOVES = [
    # chain a -> b -> c, c is live
    ("32", "2010-01-01", "COM", "a", "b"),
    ("32", "2012-01-01", "COM", "b", "c"),
    # cycle d -> e -> d
    ("31", "2010-01-01", "COM", "d", "e"),
    ("31", "2010-01-01", "COM", "e", "d"),
    # a live code never moves
    ("41", "1968-01-01", "COM", "c", "x"),
    # dead target
    ("33", "2010-01-01", "COM", "f", "gone"),
    # the latest movement wins; equal dates take the smallest target
    ("31", "2009-01-01", "COM", "g", "c"),
    ("31", "2015-01-01", "COM", "g", "m"),
    ("31", "2015-01-01", "COM", "g", "l"),
    # split: ambiguous, delegated target and name change: no move
    ("21", "2010-01-01", "COM", "s", "c"),
    ("32", "2010-01-01", "COMD", "t", "c"),
    ("10", "2010-01-01", "COM", "u", "c"),
    # real merges
    ("32", "2016-01-01", "COMD", "48022", "48022"),
    ("32", "2016-01-01", "COM", "48022", "48050"),
]


@pytest.fixture(scope="module")
def moves(spark):
    return spark.createDataFrame(MOVES, "kind string, effective string, target_type string, source string, target string")


@pytest.fixture(scope="module")
def live(spark):
    return spark.createDataFrame([("c",), ("l",), ("m",), ("48050",)], "code string")


def test_resolution(moves, live, rows):
    got = rows(codes.resolve_codes(moves, live), "source", "target", "hops")
    assert got == {("a", "c", 2), ("b", "c", 1), ("g", "l", 1), ("48022", "48050", 1)}


def test_chains_of_any_length_resolve_and_cycles_are_reported(spark, rows):
    chain = [("32", "2010-01-01", "COM", str(i), str(i + 1)) for i in range(37)]
    cycle = [("32", "2010-01-01", "COM", a, b) for a, b in (("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "gone"))]
    df = spark.createDataFrame(chain + cycle, "kind string, effective string, target_type string, source string, target string")
    live = spark.createDataFrame([("37",)], "code string")
    assert rows(codes.resolve_codes(df, live), "source", "target", "hops") == {(str(i), "37", 37 - i) for i in range(37)}
    assert rows(codes.unresolved_codes(df, live)) == {("x",), ("y",), ("z",), ("w",), ("v",)}


def test_remap_is_idempotent_and_splits_stay(spark, moves, live, rows):
    passage = codes.resolve_codes(moves, live)
    df = spark.createDataFrame([("a",), ("c",), ("s",), ("zz",)], "code string")
    once = codes.remap(df, "code", passage)
    assert rows(once) == {("c",), ("s",), ("zz",)} == rows(codes.remap(once, "code", passage))
    assert rows(codes.ambiguous_codes(moves)) == {("s",)}


def test_attachment_causes(spark, live):
    events = spark.createDataFrame([("c", "01"), ("x", "97"), ("y", "01")], "code string, dep string")
    r = codes.attachment_report(codes.attach_known(events, live, "code", F.col("dep") == "97")).first()
    assert (r.attached, r.out_of_scope, r.unresolved, r.acceptable) == (1, 1, 1, False)


def distance_m(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, 42 + 5 * rng.random(), 6 * rng.random()) for i in range(150)]
    pts += [(1000 + i, 45.0, 3.0) for i in range(20)]  # one crowded place
    pts += [(2000, 45.0, 179.9), (2001, 45.0, -179.9)]  # two sides of the antimeridian
    df = spark.createDataFrame(pts, "entity long, lat double, lon double")
    got = {(r.entity, r.neighbour): r.dist_m for r in geo.pairs_within(df, 50.0).collect()}
    want = {(p[0], q[0]): distance_m(p[1:], q[1:]) for p in pts for q in pts if p[0] != q[0]}
    want = {k: d for k, d in want.items() if d <= 50000}
    assert set(got) == set(want) and (2000, 2001) in got
    assert all(got[k] == pytest.approx(d, abs=0.01) for k, d in want.items())


def test_radius_edge(spark):
    step = 1 / geo.KM_PER_DEGREE
    df = spark.createDataFrame([(1, 45.0, 2.0), (2, 45.0 + 49.9 * step, 2.0), (3, 45.0 - 50.1 * step, 2.0)], "entity int, lat double, lon double")
    assert {(r.entity, r.neighbour) for r in geo.pairs_within(df, 50.0).collect()} == {(1, 2), (2, 1)}


def test_neighbour_features_equal_the_pair_form(spark):
    rng = random.Random(2)
    pts = [(i, 45 + rng.random(), 2 + rng.random()) for i in range(25)] + [(100 + i, 45.5, 2.5) for i in range(6)]
    points = spark.createDataFrame(pts, "entity long, lat double, lon double")
    ev = [(rng.choice(pts)[0], f"2008-01-{1 + rng.randrange(20):02d}", rng.randrange(1, 3)) for _ in range(30)]
    days = spark.createDataFrame(ev, "entity long, d string, n long").groupBy("entity", F.to_date("d").alias("day")).agg(F.sum("n").alias("n"))
    got = {(r.entity, r.day): (r.events_10km, r.events_20km, r.events_50km, round(r.events_weighted, 6)) for r in geo.neighbour_features(days, points, 50.0).collect()}
    pair = geo.pairs_within(points, 50.0).join(days.select(F.col("entity").alias("neighbour"), "day", "n"), "neighbour")
    pair = pair.select("entity", "n", "dist_m", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", 30))).alias("day"))
    want = pair.groupBy("entity", "day").agg(
        F.sum(F.when(F.col("dist_m") < 10000, F.col("n")).otherwise(0)), F.sum(F.when(F.col("dist_m") < 20000, F.col("n")).otherwise(0)),
        F.sum("n"), F.round(F.sum(F.col("n") / (F.col("dist_m") / 1000 + 1)), 6))
    assert got == {(r[0], r[1]): tuple(r)[2:] for r in want.collect()}


def test_nearest_site_and_line_equal_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, 40 + 10 * rng.random(), 10 * rng.random()) for i in range(60)] + [(99, -30.0, 150.0)]
    sites = [(i, 44 + 2 * rng.random(), 3 + 2 * rng.random()) for i in range(80)] + [(500, 70.0, -20.0)]
    p = spark.createDataFrame(pts, "entity long, lat double, lon double")
    s = spark.createDataFrame(sites, "site long, site_lat double, site_lon double")
    got = {r.entity: (r.site, round(r.dist_deg, 9)) for r in geo.nearest_site(p, s, "entity").collect()}
    want = {k: min((math.hypot(a - c, b - d), j) for j, c, d in sites) for k, a, b in pts}
    assert got == {k: (j, round(d, 9)) for k, (d, j) in want.items()}

    lines = [(a[1], a[2], b[1], b[2]) for a, b in zip(sites[:10], sites[10:20])] + [(40.0, 0.0, 50.0, 8.0)]
    seg = spark.createDataFrame(lines, "lat1 double, lon1 double, lat2 double, lon2 double")

    def to_line(pt, line):
        k = math.cos(math.radians(pt[1]))
        ax, ay, bx, by = (line[1] - pt[2]) * k, line[0] - pt[1], (line[3] - pt[2]) * k, line[2] - pt[1]
        t = max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(ax + t * (bx - ax), ay + t * (by - ay)) * geo.KM_PER_DEGREE

    near = {r.entity: r.distance_km for r in geo.distance_to_lines(p, seg).collect()}
    assert all(near[q[0]] == pytest.approx(min(to_line(q, line) for line in lines), rel=1e-9) for q in pts)


def test_axis_ties_and_sea_guard(spark):
    df = spark.createDataFrame([(1, 45.125, 2.0)], "entity int, lat double, lon double")
    assert geo.attach_cells(df, [45.25, 45.0], [2.0, 2.25]).first().cell == 0
    cells = spark.createDataFrame([(0, True)], "cell int, is_sea boolean")
    with pytest.raises(Exception, match="sea cell"):
        geo.sea_guard(geo.attach_cells(df, [45.25, 45.0], [2.0, 2.25]), cells).collect()


def brute_pairs(pts, radius_km):
    return {(p[0], q[0]) for p in pts for q in pts if p[0] != q[0] and distance_m(p[1:], q[1:]) <= radius_km * 1000}


@pytest.mark.parametrize("radius, south, west, size", [(50.0, 45.0, 179.6, 0.8), (30.0, 89.2, -180.0, 0.7), (20.0, -0.2, -0.2, 0.4)])
def test_quadtree_of_dense_squares_equals_brute_force(spark, monkeypatch, radius, south, west, size):
    """Squares split many times, over the antimeridian, at a pole and around zero; a crowded place over many blocks."""
    monkeypatch.setattr(geo, "PLACES_PER_SQUARE", 12)
    monkeypatch.setattr(geo, "ROWS_PER_BLOCK", 3)
    rng = random.Random(5)
    wide = 360.0 if south > 80 else size
    pts = [(i, min(90.0, south + size * rng.random()), (west + wide * rng.random() + 180) % 360 - 180) for i in range(120)]
    pts += [(1000 + i, *pts[0][1:]) for i in range(10)] + [(2000 + i, south + 0.1, pts[1][2] + 0.02 * i) for i in range(12)]
    pts += [(3000, 10.0, 180.0), (3001, 10.0, -180.0), (3002, -60.0, 0.0)]
    df = spark.createDataFrame(pts, "entity long, lat double, lon double")
    got = [(r.entity, r.neighbour) for r in geo.pairs_within(df, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(pts, radius)


def test_dense_square_runs_in_many_tasks(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, 45 + 0.2 * rng.random(), 2 + 0.2 * rng.random()) for i in range(3000)], "entity long, lat double, lon double")
    per_task = geo.location_pairs(df, 50.0).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 3000 * 2999
    assert len(per_task) == 4 and max(r["count"] for r in per_task) < 0.6 * 3000 * 2999


def test_pairs_of_no_points(spark):
    assert geo.pairs_within(spark.createDataFrame([], "entity long, lat double, lon double"), 50.0).collect() == []


def test_neighbour_features_shuffle_neither_pairs_nor_days(spark):
    """Before, every (place, event of a neighbour) and every day on which an entity's values change was shuffled."""
    points = spark.createDataFrame([(i, 45 + i / 100, 2.0) for i in range(20)], "entity long, lat double, lon double")
    days = spark.createDataFrame([(3, "2008-01-02", 2)], "entity long, d string, n long").select("entity", F.to_date("d").alias("day"), "n")
    above = geo.neighbour_features(days, points, 50.0)._jdf.queryExecution().executedPlan().toString().partition("MapInPandas")
    assert above[1] and "Exchange" not in above[0] and "Window" not in above[0]


def test_neighbour_features_of_repeated_and_missing_keys(spark, monkeypatch):
    """Entities listed twice, at two places, without key or without place; blocks of few entities."""
    monkeypatch.setattr(geo, "HISTORY_BLOCK", 2)
    monkeypatch.setattr(geo, "HISTORY_CELLS", 8)
    pts = [(1, 45.0, 2.0), (1, 45.0, 2.0), (2, 45.05, 2.0), (2, 45.2, 2.0), (3, 45.1, 2.0), (4, 45.0, 2.0), (None, 45.0, 2.0), (5, None, 2.0), (6, 45.3, 2.0)]
    ev = [(1, date(2008, 1, 1), 2), (2, date(2008, 1, 20), 1), (2, date(2008, 2, 3), 5), (4, date(2008, 1, 1), 3), (5, date(2008, 1, 1), 7), (3, None, 4)]
    got = geo.neighbour_features(
        spark.createDataFrame(ev, "entity long, day date, n long"), spark.createDataFrame(pts, "entity long, lat double, lon double"), 50.0
    )
    want = {}
    for e, lat, lon in pts:
        for f, day, n in ev:
            for at in [p[1:] for p in pts if p[0] == f and None not in (lat, *p[1:]) and day]:
                d = distance_m((lat, lon), at)
                for k in range(1, 31 if d <= 50000 else 1):
                    own = want.setdefault((e, day + timedelta(days=k)), [0, 0, 0, 0.0])
                    own[:] = [own[0] + n * (d < 10000), own[1] + n * (d < 20000), own[2] + n, own[3] + n / (d / 1000 + 1)]
    for f, day, n in ev:  # the entity's own events, once
        for k in range(1, 31 if day else 1):
            own = want.setdefault((f, day + timedelta(days=k)), [0, 0, 0, 0.0])
            own[:] = [v - n for v in own]
    want = {k: (*v[:3], round(v[3], 6)) for k, v in want.items() if v[2] > 0}
    assert {(r.entity, r.day): (*tuple(r)[2:5], round(r[5], 6) + 0.0) for r in got.collect()} == want

@pytest.mark.parametrize("points, lines", [(4, 8), (64, 4), (8192, 16384)])
def test_lines_of_tiles_equal_brute_force(spark, monkeypatch, points, lines):
    """Crowded tiles, blocks and parts, far points, copies, odd rows; no point meets all lines."""
    for name, value in (("TILE_POINTS", points), ("TILE_LINES", lines), ("TOGETHER", 2)):
        monkeypatch.setattr(geo, name, value)
    rng = random.Random(points)
    pts = [(i, 40 + 10 * rng.random(), 10 * rng.random()) for i in range(300)]
    pts += [(300 + i, 45 + 0.01 * rng.random(), 5 + 0.01 * rng.random()) for i in range(60)] + [(360 + i, 45.0, 5.0) for i in range(20)]
    pts += [(400, -30.0, 150.0), (401, 89.9, -179.0), (402, 0.0, 0.0), (403, -0.1, 359.0), (0, 44.0, 4.0)]
    segments = []
    for _ in range(150):
        lat, lon = 40 + 10 * rng.random(), 10 * rng.random()
        segments.append((lat, lon, lat + rng.uniform(-3, 3), lon + rng.uniform(-3, 3)))
    segments += [(45.002, 5.001, 45.002, 5.001), segments[0], (-31.0, 149.0, -29.0, 152.0)]
    odd = [(500, None, 3.0), (None, 44.0, 4.0), (0, None, None)]
    p = spark.createDataFrame(pts + odd + pts[:5], "entity long, lat double, lon double")
    s = spark.createDataFrame(segments + [(None, 1.0, 2.0, 3.0)], "lat1 double, lon1 double, lat2 double, lon2 double")
    lat, lon, seg = np.array([r[1] for r in pts]), np.array([r[2] for r in pts]), np.array(segments).T
    k = np.maximum(np.cos(np.radians(lat)), 0.01)[:, None]
    ax, ay = (seg[1] - lon[:, None]) * k, seg[0] - lat[:, None]
    bx, by = (seg[3] - lon[:, None]) * k, seg[2] - lat[:, None]
    size = (bx - ax) ** 2 + (by - ay) ** 2
    t = np.clip(-(ax * (bx - ax) + ay * (by - ay)) / np.where(size > 0, size, 1), 0, 1)
    want = {}
    for (e, *_), d in zip(pts, (np.hypot(ax + t * (bx - ax), ay + t * (by - ay)) * geo.KM_PER_DEGREE).min(axis=1)):
        want[e] = min(want.get(e, math.inf), d)
    got = {r.entity: r.distance_km for r in geo.distance_to_lines(p, s).collect()}
    assert set(got) == set(want) and all(got[e] == pytest.approx(d, rel=1e-7, abs=1e-9) for e, d in want.items())
    assert geo.distance_to_lines(p, s.limit(0)).isEmpty() and geo.distance_to_lines(p.limit(0), s).isEmpty()


def test_points_meet_fewer_lines_than_there_are(monkeypatch):
    """100 times the lines and points: each point meets less than 100 times as many lines."""
    met = []
    inner = geo._degrees_to_lines
    monkeypatch.setattr(geo, "_degrees_to_lines", lambda lat, lon, k, lines: met.append(np.size(lat) * lines.shape[1]) or inner(lat, lon, k, lines))
    rng, cost = np.random.default_rng(1), []
    for n in (200, 20000):
        a, step = rng.uniform((40, 0), (50, 10), (n // 20, 2)), rng.uniform(-5, 5, (n // 20, 2))
        met.clear()
        geo._closest_line(*rng.uniform((40, 0), (50, 10), (n, 2)).T, np.c_[a, a + step].T)
        cost.append(sum(met))
    assert cost[1] < 1000 * cost[0]  # all pairs are 10,000 times as many
