import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelrisk.llm import quality_rules as q


def by_hand(text, least=6):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n = len(words)
    spans = {}
    for k in range(n - 2):
        spans.setdefault(tuple(words[k : k + 3]), []).append(k)
    windows = {k + d for at in spans.values() if len(at) > 1 for k in at for d in range(3)}
    longest = [0] * n
    for i in range(n):
        for j in range(i):
            m = 0
            while i + m < n and words[i + m] == words[j + m]:
                m += 1
            longest[i], longest[j] = max(longest[i], m), max(longest[j], m)
    covered = {k for i in range(n) if longest[i] >= least for k in range(i, i + longest[i])}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(windows), "covered_words": len(covered), "longest_repeat": max(longest, default=0),
        "base_failed": n < 50 or 100 * len(windows) > 50 * n,
    }


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(("a ", "b ", "é ", "c\n", "#| ", "a b ")) for _ in range(rng.randint(0, 70))) for _ in range(60)]
    texts += [None, "", "  \n", "x", "x x", "x x x", "x " * 120, "one two three four five six seven " * 9, "a\n\na\n \nb\n"]
    got = q.measure(texts, q.Rules())
    want = pd.DataFrame([by_hand(t) for t in texts])
    pd.testing.assert_frame_equal(got[list(want)].reset_index(drop=True), want, check_dtype=False)


def test_repeats_stay_inside_a_text():
    got = q.measure(["a b c d e f g h", "a b c d e f g h"], q.Rules())
    assert got.longest_repeat.tolist() == [0, 0]


def test_verdicts():
    clean = " ".join(f"word{k}" for k in range(300))
    twice = " ".join(f"word{k}" for k in range(40)) + " other " + " ".join(f"word{k}" for k in range(40))
    assert q.measure([clean, twice, "too short", clean + " " + clean], q.Rules()).kept.tolist() == [True, False, False, False]


def test_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.length("text") < 2500)
    rated, name = q.with_quality(docs)
    for row in rated.collect():
        want = by_hand(row.text)
        assert {k: row[name][k] for k in want} == want


def test_odd_rows(spark, odd_docs, no_docs):
    rated, name = q.with_quality(odd_docs)
    assert name == "quality_" and rated.columns[:-1] == odd_docs.columns and rated.count() == odd_docs.count()
    got = {r.doc_id: r[name] for r in rated.collect() if r.doc_id in (3, 4, 5)}
    assert all(g.n_words == 0 and g.base_failed and not g.kept for g in got.values()) and got[5].word_chars == 0
    assert q.with_quality(no_docs)[0].count() == 0
