import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from panelrisk.llm import bpe, pii
from panelrisk.llm.queries import ORACLE_SQL, QUERIES

from .test_decontaminate import contained_by_hand
from .test_quality_rules import by_hand
from .test_simhash import components, plain_fingerprint


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "bpe"]
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in QUERIES} and not set(ORACLE_SQL) - set(QUERIES)


def test_run_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {}
    for key, text in docs.items():
        m = by_hand(text)
        if not m["base_failed"] and 100 * m["covered_words"] <= 50 * m["n_words"] and (m["longest_repeat"] < 6 or 100 * m["longest_repeat"] <= 40 * m["n_words"]):
            kept[key] = text
    ids = sorted(kept)
    least = components([plain_fingerprint(kept[k]) for k in ids], lambda x, y: (x ^ y).bit_count() <= 3)
    kept = {k: kept[k] for n, k in enumerate(ids) if least[n] == n}
    kept = {k: pii.masked(t) for k, t in kept.items() if all(contained_by_hand(i, t) < 0.8 for i in items)}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = {}
    for key, text in kept.items():
        tokens = library.encode(text, add_special_tokens=False).ids
        want[key] = (len(tokens), sha(" ".join(map(str, tokens))), sha(library.decode(tokens, skip_special_tokens=False)))
    assert 0 < len(want) < len(docs)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_stages_take_odd_rows_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "bpe" or out.columns == docs.columns
            rows = out.count()
            assert rows == docs.count() or name in ("quality_rules", "near_dedup")
    deduped = corpus_pipeline.STAGES[1][1](spark, odd_docs, sf_dir).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in deduped) == [(0, ""), (0, "alpha"), (1, "alpha"), (3, ""), (6, "anoth"), (6, "word ")]


def test_masking_counts_characters_anew(spark, sf_dir):
    docs = spark.createDataFrame([(1, "mail a@b.com", 12), (2, None, 7)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).collect()}
    assert rows == {1: ("mail [EMAIL]", 12), 2: (None, 7)}
