import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelrisk.llm import queries
from panelrisk.llm import token_alignment as t


@pytest.fixture(scope="module")
def tokenizers():
    contents = []
    for path in t.default_paths():
        with open(path, "rb") as file:
            contents.append(file.read())
    return t.Tokenizers(*contents)


def by_hand(tokenizers, text):
    """(groups, links) of a text by walking its bytes."""
    whole = (" " + (text or "")).encode()
    a, b = tokenizers.a.encode(" " + (text or ""), add_special_tokens=False).ids, tokenizers.b.encode(text or "")
    if not text or b"".join(tokenizers.a_bytes[i] for i in a) != whole or b"".join(tokenizers.b_bytes[i] for i in b) != whole:
        return [], [], 0, 0
    spans = []
    for ids, names in ((a, tokenizers.a_bytes), (b, tokenizers.b_bytes)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(names[i]), i))
            at += len(names[i])
        spans.append(out)
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    number = {cut: k for k, cut in enumerate(cuts)}
    groups, now = [([], []) for _ in cuts], [0, 0]
    for k, side in enumerate(spans):
        for _, e, i in side:
            groups[now[k]][k].append(i)
            now[k] = number[e] + 1 if e in number else now[k]
    owners = [[], []]
    for side, own in zip(spans, owners):
        for k, (s, e, _) in enumerate(side):
            own += [k] * (e - s)
    links = [(spans[0][x][2], spans[1][y][2]) for x, y in sorted(set(zip(*owners)))]
    return groups, links, len(a), len(b)


def expected(tokenizers, rows):
    done = [by_hand(tokenizers, text) for _, text in rows]
    counts = Counter(link for _, links, _, _ in done for link in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (doc, _), (groups, links, n_a, n_b) in zip(rows, done):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return out


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def as_rows(df):
    return sorted((tuple(r) for r in df.select(*FIELDS).collect()), key=repr)


ODD = [
    "", " ", "  two  spaces ", "plain words, and more words.", "naïve façade – “quotes” … €5", "日本語のテキストと漢字", "emoji 👩‍👩‍👧 and 🏴󠁧󠁢󠁥󠁮󠁧󠁿", "tab\tand\nlines\r\n\r\n",
    "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "x" * 5000, "ab " * 4000, "\x00 nul", "a\x00b a\x00c a", "é" * 300, "1234567890 " * 50, "ﬁ ligature ① Ⅷ", "é combining", "don't I'LL we've",
]


def test_bytes_of_the_vocabularies(tokenizers):
    assert tokenizers.a_bytes[50256] == b"<|endoftext|>"
    assert min(map(len, tokenizers.a_bytes)) > 0 and min(map(len, tokenizers.b_bytes)) > 0
    assert sorted(t.byte_alphabet().values()) == list(range(256))


def test_odd_texts_against_bytes(tokenizers):
    g = t.Groups(tokenizers, *tokenizers.encode(ODD))
    hands = [by_hand(tokenizers, x) for x in ODD]
    assert g.lists() == [[{"a": a, "b": b} for a, b in groups] for groups, *_ in hands]
    links = np.split(g.links, g.link_stops[:-1])
    assert [[(x >> 32, x & 0xFFFFFFFF) for x in each.tolist()] for each in links] == [links for _, links, *_ in hands]
    assert sum(len(h[0]) > 0 for h in hands) >= 12 and not hands[9][0] and not hands[10][0]


@pytest.mark.parametrize("seed", range(4))
def test_cuts_against_intersection(seed):
    """Any two ways to cut a row of bytes, from no common end to all of them."""
    rng = np.random.default_rng(seed)
    for _ in range(200):
        size = int(rng.integers(1, 400))
        a, b = (np.unique(np.r_[rng.integers(1, size + 1, rng.integers(0, size + 1)), size]) for _ in "ab")
        last = np.flatnonzero(np.isin(a, b))
        known = np.unique(np.r_[rng.choice(last, rng.integers(0, len(last) + 1)), len(a) - 1])
        assert t.cut_ends(a, b, known).tolist() == last.tolist()


def test_long_stretch_without_a_cut_is_searched_in_rounds():
    a, b = np.arange(2, 2_000_001, 2), np.r_[np.arange(1, 2_000_000, 2), 2_000_000]
    assert t.cut_ends(a, b, np.array([len(a) - 1])).tolist() == [len(a) - 1]


def test_rows_against_brute_force(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_BYTES", 500)
    rng = random.Random(1)
    words = "the of and naïve token tokenization running unbelievable 12345 — ( ) , . ; straße 日本 Überprüfung".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(80)] + [(100 + k, x) for k, x in enumerate(ODD)]
    rows += [(None, "no id"), (7, None), (7, "same id"), (7, "same id"), (300, ODD[3])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, id string, block string").repartition(3)
    got = t.alignments(df)
    assert got.columns == ["doc_id", *[f for f in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")]]
    assert as_rows(got) == sorted(expected(tokenizers, rows), key=repr)


def test_groups_column(spark, tokenizers):
    df = spark.createDataFrame([(1, ODD[3], "taken"), (2, None, None), (3, "a▁b", "x")], "doc_id long, text string, groups string")
    out, name = t.with_groups(df)
    assert name == "groups_" and out.columns == [*df.columns, name]
    found = {r["doc_id"]: r[name] for r in out.collect()}
    assert [(list(g["a"]), list(g["b"])) for g in found[1]] == by_hand(tokenizers, ODD[3])[0]
    assert found[2] == [] and found[3] == []


def test_query_on_a_table(spark, sf_dir, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(queries.op13_token_alignment(spark, sf_dir)) == sorted(expected(tokenizers, rows), key=repr)


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs, tokenizers):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert as_rows(t.alignments(odd_docs)) == sorted(expected(tokenizers, rows), key=repr)
    assert as_rows(t.alignments(no_docs)) == []


@pytest.mark.parametrize("seed", range(3))
def test_chunks_are_encoded_as_in_the_whole(tokenizers, seed):
    """Words apart give the ids of the whole text, whatever white space, letters and signs stand between them."""
    rng = random.Random(seed)
    signs = [" ", " ", " ", " ", "\n", "\t", "\r", "\x1c", " ", " ", "　", "\u0085", "​", "̈", "a", "é", "'s", "'", "9", "½", "日", "▁", "<0x41>", "<s>", "!", "👍", "\x00", "word", "Ⅷ", "ß"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    assert tokenizers.cuts_at_words
    for text, a, b in zip(texts, *tokenizers.encode(texts)):
        each = tokenizers.encode(tokenizers.chunks(text))
        if all(each[0]):
            assert ([i for x in each[0] for i in x], [i for x in each[1] for i in x]) == (a, b), repr(text)
        else:
            assert not a and not b, repr(text)


def test_kept_chunks_are_emptied(tokenizers, monkeypatch):
    monkeypatch.setattr(t, "KEPT", 2)
    kept = t.Chunks(tokenizers)
    for words in (["alpha", "beta gamma", "alphabet"], ["delta", "alpha"], ["alpha", "delta", "epsilon"]):
        places = kept.look_up(words)
        assert [kept.figures[p, 3] for p in places] == [len(by_hand(tokenizers, w)[0]) for w in words]
