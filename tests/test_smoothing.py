import pytest
from pyspark.sql import functions as F

from panelrisk.operators import smoothing as sm

YEARS = (2006, 2007, 2008, 2009)
EVENTS = {"A": dict.fromkeys(YEARS, 10), "B": {2007: 4}, "C": {}}


@pytest.fixture(scope="module")
def counts(spark):
    data = [(e, y, 1000, EVENTS[e].get(y, 0)) for e in EVENTS for y in YEARS]
    return spark.createDataFrame(data, "entity string, year int, days long, events long")


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame([("A", 0), ("B", 0), ("C", 1)], "entity string, cluster int")


@pytest.fixture(scope="module")
def rates(counts, clusters):
    return {(r.entity, r.excluded_year): r for r in sm.smooth_rates(counts, clusters).collect()}


def test_one_row_per_entity_and_excluded_year(rates):
    assert set(rates) == {(e, y) for e in "ABC" for y in (0, *YEARS)}


def test_own_year_is_removed(rates):
    assert rates[("B", 2007)].entity_rate < rates[("B", 2006)].entity_rate
    # Without 2007, B has no event left: its rate is its prior shrunk by the full exposure.
    r = rates[("B", 2007)]
    assert r.entity_rate == pytest.approx(2000 * r.cluster_rate / (4000 + 2000))


def test_exposure_stays_constant(rates):
    # A silent entity has the same ratio whatever the excluded year.
    assert len({round(rates[("C", y)].rate_ratio, 12) for y in (0, *YEARS)}) == 1
    base = (40 + 4) / 12000
    cluster = ((40 + 4 - 10) * 8000 / 6000 + 20000 * base) / (8000 + 20000)
    assert rates[("A", 2006)].cluster_rate == pytest.approx(cluster)


def test_shrinkage_lies_between_raw_rate_and_prior(rates):
    for e, total in (("A", 40), ("B", 4), ("C", 0)):
        r = rates[(e, 0)]
        low, high = sorted((total / 4000, r.cluster_rate))
        assert low <= r.entity_rate <= high


def test_missing_profile_gets_its_own_group(spark, counts, rows):
    known = spark.createDataFrame([("A", 0), ("C", 1)], "entity string, cluster int")
    assert rows(sm.with_fallback_cluster(counts, known), "entity", "cluster") == {("A", 0), ("C", 1), ("B", -1)}


def test_application_reads_the_right_year(spark, counts, clusters, rates):
    matrix = spark.createDataFrame([("B", 2007, "train"), ("B", 2021, "val")], "entity string, year int, split string")
    table = sm.smooth_rates(counts, clusters)
    got = {r.split: r.entity_rate for r in sm.apply_rates(matrix, table).collect()}
    assert got == {"train": pytest.approx(rates[("B", 2007)].entity_rate), "val": pytest.approx(rates[("B", 0)].entity_rate)}


def test_unknown_entity_fails(spark, counts, clusters):
    matrix = spark.createDataFrame([("Z", 2007, "train")], "entity string, year int, split string")
    with pytest.raises(Exception, match="no smoothed rate for entity Z"):
        sm.apply_rates(matrix, sm.smooth_rates(counts, clusters)).collect()


def test_held_out_entities_inherit_their_cluster(spark, counts, clusters):
    out = sm.smooth_rates_without(counts, clusters, clusters.filter("entity = 'B'"))
    got = {r.entity: r for r in out.collect()}
    assert got["B"].entity_rate == got["B"].cluster_rate == got["A"].cluster_rate
    base = 40 / 8000
    assert got["A"].cluster_rate == pytest.approx((40 + 20000 * base) / (4000 + 20000))


def test_single_level(spark):
    row = spark.range(1).select(F.lit(2).alias("e"), F.lit(100).alias("d")).select(sm.single_level("e", "d", F.lit(0.01)).alias("r")).first()
    assert row.r == pytest.approx((2 + 500 * 0.01) / 600)
