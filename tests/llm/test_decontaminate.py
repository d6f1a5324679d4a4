import random
import re

import numpy as np
import pytest

from panelrisk.llm import decontaminate as d


def words_by_hand(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower()) if w]


def contained_by_hand(item, text):
    own, words = words_by_hand(item), words_by_hand(text)
    width = min(5, len(own))
    shingles = {tuple(own[k : k + width]) for k in range(len(own) - width + 1)}
    there = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
    return len(shingles & there) / len(shingles) if width else 0.0


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    items = [(k, " ".join(word() for _ in range(rng.choice((1, 3, 4, 5, 9, 30, 90, 400))))) for k in range(40)]
    texts = []
    for _ in range(120):
        words = [word() for _ in range(rng.randint(0, 1500))]
        for _, item in rng.sample(items, 3):
            own = item.split()
            for _ in range(rng.choice((0, 0, 1, len(own) // 20))):
                own[rng.randrange(len(own))] = "zz"
            at = rng.randint(0, len(words))
            words[at:at] = own
        texts.append(" ".join(words))
    return items, texts


@pytest.mark.parametrize("seed", range(3))
def test_search_finds_what_brute_force_finds(seed):
    items, texts = corpus(seed)
    found = d.Items(items).find(texts)
    for text, got in zip(texts, found):
        want = {i: c for i, item in items if (c := contained_by_hand(item, text)) >= 0.8}
        assert {i: c for i, c, *_ in got} == pytest.approx(want)


def test_case_and_punctuation_do_not_hide_an_item():
    assert d.Items([(1, "The quick brown fox jumps over it")]).find(["so: THE QUICK, brown fox\njumps over it!"])[0][0][:2] == (1, 1.0)


def test_table_against_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    searched, name = d.with_leaks(docs, items)
    own = [(r.item_id, r.text) for r in items.collect()]
    assert any(r[name] for r in searched.collect())
    for row in searched.collect():
        assert {x.item for x in row[name]} == {i for i, text in own if contained_by_hand(text, row.text) >= 0.8}


def test_items_in_blocks_give_the_same(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    whole, name = d.with_leaks(docs, items)
    want = {r.doc_id: r[name] for r in whole.collect()}
    monkeypatch.setattr(d, "ITEM_BYTES", 3000)
    cut, name = d.with_leaks(docs, items)
    assert {r.doc_id: r[name] for r in cut.collect()} == want


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, ""), (None, "same id"), (4, "...")], "item_id long, text string")
    searched, name = d.with_leaks(odd_docs, items)
    assert name == "leaks_" and searched.count() == odd_docs.count()
    got = [(r.doc_id, [x.item for x in r[name]]) for r in searched.collect()]
    assert got.count((1, [1])) == 2 and (2, [1]) in got and (None, [1]) in got and (6, [None]) in got and (3, []) in got
    assert d.with_leaks(no_docs, items)[0].count() == 0
    assert all(r[name] == [] for r in d.with_leaks(odd_docs, items.limit(0))[0].select(name).collect())


def test_signature_keeps_the_least_hash_of_each_bin():
    hashes = np.array([5, 9, (1 << 57) + 3, (1 << 57) + 1], np.uint64)
    assert d.signature(hashes)[:3].tolist() == [5, (1 << 57) + 1, 2**64 - 1]
