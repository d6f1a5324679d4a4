import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from panelrisk.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    least = list(range(len(values)))

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(values))]


def test_fingerprint_by_hand():
    for text in (None, "", " \n", "One", "one two", "one two three", "A b c d É é E", "x y z x y z x y z", "Ünder THE same sky\tand\vmore words\fhere"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_forest_finds_what_all_pairs_find():
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(50)}
    for v in list(values):
        for _ in range(12):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    values = np.array(sorted(values), np.uint64)
    a, b = simhash.forest_links(np.zeros(len(values), int), values, np.ones(len(values), bool), 3)
    at = {int(v): k for k, v in enumerate(values)}
    found = {(at[int(x)], at[int(y)]) for x, y in zip(a, b)}
    near = components(list(map(int, values)), lambda x, y: (x ^ y).bit_count() <= 3)
    assert components(range(len(values)), lambda x, y: (x, y) in found or (y, x) in found) == near
    assert len(found) <= len(values) - len(set(near))


def test_components_of_fingerprints_in_spark(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)  # so that shards are cut into several trees
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(60)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    want = components(signed, lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count() <= 3)
    assert [root.get(v, v) for v in signed] == [signed[k] for k in want]


def test_chain_of_links_is_one_component(spark):
    chain = [(1 << (3 * k)) - 1 for k in range(20)]  # neighbours differ in three bits, others in more
    edges = simhash.links(spark.createDataFrame([(v,) for v in chain], "fp long"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = [plain_fingerprint(texts[i]) for i in ids]
    want = components(prints, lambda x, y: (x ^ y).bit_count() <= 3)
    assert [rows[i].component_id for i in ids] == [ids[k] for k in want]
    assert [rows[i].fp % (1 << 64) for i in ids] == prints


def test_odd_rows(spark, odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).orderBy(F.col("doc_id").asc_nulls_last(), "fp").collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found if r.doc_id not in (None, 6)}
    assert by_id[2].component_id == by_id[1].component_id == 1 and by_id[2].n_linked == 4
    assert by_id[3].fp == by_id[4].fp == by_id[5].fp == 0 and by_id[5].component_id == 3
    assert simhash.near_duplicates(no_docs).count() == 0
