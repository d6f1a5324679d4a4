import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrisk.llm import quality_classifier as q


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.1"
    return q.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    folder = "/root/testdata/sf0.1"
    rated, name = q.with_score(spark.read.parquet(f"{folder}/documents.parquet"), model)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = rated.join(labels, "doc_id").filter(q.is_held_out(F.col("doc_id"))).select("quality", name).collect()
    right = np.mean([(r[name] >= q.PREDICT_AT) == (r.quality == 1) for r in rows])
    clean = np.mean([r[name] >= q.PREDICT_AT for r in rows if r.quality == 1])
    assert len(rows) > 500 and right > 0.97 and clean > 0.98


def test_held_out_rows_are_the_remainder_two(spark):
    rows = spark.range(400).select("id", q.is_held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_held_out_labels_teach_nothing(spark):
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    keys = [r.key for r in q.sample(labels, "doc_id", "quality").collect()]
    assert keys and all(zlib.crc32(str(k).encode()) % 4 != 2 for k in keys)


def test_scores_read_the_whole_text(model):
    share, base = model.log_odds()
    clean = "Then the erntre is to be with that and the hanoust of reering. " * 200
    one, other = q.score([clean, clean + "Of%%% athe*** erntwh.%%% Thntatwh&&& " * 600], share, base)
    assert one > 0.9 > other


def test_collapsed_scorer_is_the_two_layers(model):
    text = "Some words, some words and Others"
    buckets, _ = q.features([text.encode()])
    mean = model.vectors[buckets].astype(float).mean(axis=0)
    logits = mean @ model.weights + model.bias
    want = 1 / (1 + np.exp(-(model.scale * (logits[1] - logits[0]) + model.shift)))
    assert q.score([text], *model.log_odds())[0] == pytest.approx(want, abs=1e-4)


def test_training_is_repeatable_and_survives_odd_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 0, 0), (None, 1, 0), (4, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    one, two = (q.train(odd_docs, labels) for _ in range(2))
    assert (one.vectors == two.vectors).all() and (one.bias == two.bias).all()
    rated, name = q.with_score(odd_docs, one)
    assert name == "score_" and rated.count() == odd_docs.count()
    empty = {r[name] for r in rated.filter("doc_id in (3, 4)").collect()}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1
    assert q.with_score(no_docs, q.train(odd_docs, labels.limit(0)))[0].count() == 0
