"""Boosted models scored a batch of rows at a time, and the learning curve's model."""
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelrisk.operators import metrics, models

COLUMNS = ["a", "b", "c", "unused"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(600):
        a, b = float(rng.normal()), float(rng.integers(0, 9))
        rows.append((k, None if k % 17 == 0 else a, b, float(rng.normal()), 1.0, int(a + b / 4 + rng.normal() > 1)))
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, unused double, y int").cache()
    return models.train(df, COLUMNS, "boosted", maxIter=12, maxDepth=4), df


def test_scores_are_the_learners(fitted):
    """Before, rows went back from Python as vectors that the learner walked one by one."""
    model, df = fitted
    want = {r.k: r.p for r in model.learner.transform(model.prepare(df)).select("k", vector_to_array("probability")[1].alias("p")).collect()}
    scored = models.score(model, df, ["k", "y"])
    got = {r.k: r.score for r in scored.collect()}
    assert set(got) == set(want) and len(set(got.values())) > 20
    assert all(got[k] == pytest.approx(p, abs=1e-12) for k, p in want.items())
    above = scored._jdf.queryExecution().optimizedPlan().toString().partition("InMemoryRelation")
    assert above[1] and "probability(array(" in above[0] and "unused" not in above[0] and "features" not in above[0]


def test_a_feature_without_value_and_median_stops_the_scoring(spark, fitted):
    model, df = fitted
    unknown = spark.createDataFrame([(None, 1.0, 1.0, 1.0)], "a double, b double, c double, unused double")
    with pytest.raises(Exception, match="neither a number nor has a median"):
        models.score(models.Model(model.learner, COLUMNS, unknown), df, ["k"]).collect()


def test_single_leaf_trees_are_scored(spark):
    df = spark.createDataFrame([(k, 1.0, 1) for k in range(10)], "k long, a double, y int")
    model = models.train(df, ["a"], "boosted", maxIter=2, maxDepth=2)
    want = [r.p for r in model.learner.transform(model.prepare(df)).select("k", vector_to_array("probability")[1].alias("p")).orderBy("k").collect()]
    assert [r.score for r in models.score(model, df, ["k"]).orderBy("k").collect()] == pytest.approx(want)


def test_rows_are_scored_once_for_their_evaluation(spark, fitted):
    """Before, the edges of the value ranges and the totals each scored all rows."""
    model, df = fitted
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(score):
        seen.add(1)
        return score

    scored = models.score(model, df, ["y"]).withColumn("score", counted.asNondeterministic()("score"))
    found = models.evaluate(scored).first()
    assert found.rows == 600 and seen.value == 600


def test_curve_is_that_of_prefixes(fitted):
    """Every point is the average precision after so many trees; the plan doesn't grow with the trees."""
    model, df = fitted
    got = {r.trees: (r.average_precision, r.rows) for r in models.learning_curve(model, df).collect()}
    long = df.select("y")
    margins = model.prepare(df).select("features", "y")
    for i, tree in enumerate(model.learner.trees):
        margins = tree.setPredictionCol(f"_t{i}").transform(margins)
    total = None
    for i, w in enumerate(model.learner.treeWeights):
        term = F.col(f"_t{i}") * F.lit(float(w))
        total = term if total is None else total + term
        want = metrics.average_precision(metrics.score_groups(margins.select("y", total.alias("score")), "score", "y")).first()
        assert got[i + 1] == (pytest.approx(want.average_precision), 600)
    assert set(got) == set(range(1, 13)) and long.count() == 600
    assert {r.trees for r in models.learning_curve(model, df, steps=[3, 12, 40]).collect()} == {3, 12}


def test_learning_curve_has_all_the_trees(monkeypatch):
    """Before, the curve ended after 5 trees of depth 3; the original's has 600 of depth 6."""
    from types import SimpleNamespace

    from panelrisk.plans import model_queries as mq

    asked = []
    rows = SimpleNamespace(filter=lambda _: rows)
    monkeypatch.setattr(mq, "train_matrix", lambda t: rows)
    monkeypatch.setattr(mq, "feature_columns", lambda r: ["a"])
    monkeypatch.setattr(mq, "fit_years", lambda: None)
    monkeypatch.setattr(mq, "judge_years", lambda: None)
    monkeypatch.setattr(mq.models, "train", lambda r, columns, kind, **params: asked.append((kind, params)) or "model")
    monkeypatch.setattr(mq.models, "learning_curve", lambda model, r: (model, r))
    assert mq.learning_curve(None) == ("model", rows)
    [(kind, params)] = asked
    assert kind == "boosted" and params["maxIter"] == 600 and params["maxDepth"] == 6 and params["stepSize"] == 0.05
