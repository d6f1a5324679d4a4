import random

import numpy as np
import public_tokenizers
import pytest

from panelrisk.llm import token_counts as t


@pytest.fixture(scope="module")
def encoder():
    with open(t.default_vocabulary(), "rb") as file:
        return t.Encoder(file.read(), public_tokenizers.PATTERN)


def by_hand(ends, borders, rule):
    """Byte by byte: who owns each byte of each token."""
    counts, crossing, start = [0.0] * len(borders), 0, 0
    owner = [next(k for k, b in enumerate(borders) if byte < b) for byte in range(borders[-1])] if len(borders) else []
    for end in ends:
        own = owner[start:end]
        crossing += len(set(own)) > 1
        if rule == "first":
            counts[own[0]] += 1
        elif rule == "majority":
            counts[max(sorted(set(own)), key=own.count)] += 1
        else:
            for k in own:
                counts[k] += 1 / len(own)
        start = end
    return counts, crossing


@pytest.mark.parametrize("rule", t.RULES)
@pytest.mark.parametrize("seed", range(3))
def test_attribution_against_bytes(rule, seed):
    rng = random.Random(seed)
    for _ in range(200):
        ends = np.cumsum([rng.randint(1, 6) for _ in range(rng.randint(1, 30))])
        borders = np.array(sorted(rng.randint(0, int(ends[-1])) for _ in range(rng.randint(0, 8))) + [int(ends[-1])])
        counts, crossing = t.attribute(ends, borders, rule)
        want, want_crossing = by_hand(ends.tolist(), borders.tolist(), rule)
        assert counts.tolist() == pytest.approx(want) and crossing == want_crossing


def test_spans_round_trip(encoder):
    for text in ("", "Hello world", "naïve 日本語 é\n\n  x", "a​b 🎉🎉 ok"):
        ends = encoder.ends(text)
        assert (int(ends[-1]) if len(ends) else 0) == len(text.encode())
        spans = encoder.spans(text)
        assert len(spans) == len(ends) and all(a < z <= len(text) for a, z in spans)
        assert {k for a, z in spans for k in range(a, z)} == set(range(len(text)))


def test_crossing_tokens_follow_the_rule(encoder):
    ends = encoder.ends("a\n\n\nb")
    borders = np.array([2, 3, 4, 5])
    assert t.attribute(ends, borders, "split")[0].sum() == len(ends)


def test_table_adds_up(spark, sf_dir, encoder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted, name = t.with_token_counts(docs, ["source", "lang", "text"], sectioned="text")
    for row in counted.collect():
        whole = f"{row.source}\n{row.lang}\n{row.text}"
        found = row[name]
        assert found.n_tokens == len(encoder.encoding.encode_ordinary(whole)) == found.source + found.lang + found.text
        assert sum(found.sections) == found.text and len(found.sections) == row.text.count("\n") + 1
        borders = np.cumsum([len(p.encode()) for p in (row.source + "\n", row.lang + "\n", row.text)])
        assert [found.source, found.lang, found.text] == by_hand(encoder.ends(whole).tolist(), borders.tolist(), "majority")[0]


def test_odd_rows(spark, odd_docs, no_docs):
    counted, name = t.with_token_counts(odd_docs, ["lang", "text"], sectioned="text")
    assert name == "tokens_" and counted.count() == odd_docs.count()
    rows = {(r.doc_id, r.lang): r[name] for r in counted.collect() if r.doc_id in (4, None)}
    assert rows[4, "en"].text == 0 and rows[4, "en"].lang == rows[4, "en"].n_tokens == 2
    assert rows[None, None].n_tokens == 1  # the border between two empty fields
    assert t.with_token_counts(no_docs, ["text"])[0].count() == 0
    with pytest.raises(ValueError, match="rule"):
        t.with_token_counts(odd_docs, ["text"], rule="other")
