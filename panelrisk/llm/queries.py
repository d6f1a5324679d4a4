"""One query per operator: it applies the operator to its whole table and derives the digest columns."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, html_extract, licenses, multi_index, pii, quality_classifier, quality_rules, simhash, substring_dedup, token_alignment, token_counts
from .vectors import is_usable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_linked")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, name = bpe.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.default_vocabulary())
    return tokens.select("doc_id", *bpe.digests(name))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted, name = html_extract.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extracted.select("page_id", "url", F.col(name).alias("text"), F.char_length(name).cast("long").alias("n_chars"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    rated, name = quality_classifier.with_score(docs, model)
    predicted = (F.col(name) >= quality_classifier.PREDICT_AT).cast("int").alias("predicted")
    return rated.select("doc_id", quality_classifier.is_held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), predicted)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each paragraph that gives a licence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned, name = licenses.with_licenses(docs, licenses.train(docs))
    return scanned.select("doc_id", F.explode(name).alias("found")).select("doc_id", "found.*")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    plain = F.filter(F.col(name), lambda s: s["plain"])
    counts = [count(kind) for kind in pii.KINDS]
    disguised = F.size(F.filter(F.col(name), lambda s: ~s["plain"])).cast("long")
    return found.select("doc_id", *counts, F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col(name)).alias("spans"), disguised.alias("n_disguised"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a document's fields and of the lines of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted, name = token_counts.with_token_counts(docs, ["source", "lang", "text"], sectioned="text")
    found = F.col(name)
    return counted.select(
        "doc_id", found["n_tokens"].alias("n_tokens"), found["source"].alias("source_tokens"), found["lang"].alias("lang_tokens"), found["text"].alias("text_tokens"),
        F.size(found["sections"]).alias("n_sections"), found["sections"].alias("section_tokens"), found["crossing"].alias("n_crossing"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), exact=True)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, name = quality_rules.with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rated.select("doc_id", F.col(f"{name}.*"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    searched, name = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return searched.select("doc_id", F.explode(name).alias("leak")).select("doc_id", F.col("leak.item").alias("item_id"), "leak.containment", "leak.shared", "leak.shingles")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(is_usable("embedding")).select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector"),
    )
    return hard_negatives.hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multi_index.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.alignments(table(spark, sf_dir, "documents"))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_html_extract": op3_html_extract,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_licenses": op5_licenses,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_multi_index": op12_multi_index,
    "op13_token_alignment": op13_token_alignment,
}

#: Hard negatives can be written as joins and windows; the others can't as a whole, tests/llm has brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
WITH vecs AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, r.label = a.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM vecs a JOIN vecs r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), windows AS (
    SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS place
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM windows WHERE place <= 10
""",
}
