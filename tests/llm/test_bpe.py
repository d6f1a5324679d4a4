import random
import unicodedata

import pytest
from tokenizers import Tokenizer

from panelrisk.llm import bpe

PATH = bpe.default_vocabulary()
VOCABULARY = bpe.Vocabulary(bpe.read_vocabulary(PATH))
LIBRARY = Tokenizer.from_file(PATH)


def encoder(words=()):
    return bpe.Encoder(VOCABULARY, bpe.Lexicon(bpe.compile_lexicon({w.encode(): VOCABULARY.merge(w) for w in words})))


def agrees(own, text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert VOCABULARY.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_texts_against_the_library():
    own = encoder(["hello", "the", "world", "日本", "é"])
    for text in ("", "  ", "Hello, World's  Éa 123 don't!! 日本語\n x", "ΑΣ Σ İ", "é K ß", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|endoftext|>", "a\x1cb\x85c d\xa0e", "thndre" * 3000, "a" * 23 + " " + "a" * 24 + " " + "ab" * 13):
        agrees(own, text)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_against_the_library(seed):
    rng, own = random.Random(seed), encoder()
    letters = "abcdefghij KΣσİÉé  \n\t\x85\x1c12٣'s't'll!!#日本​<|endoftext|>"
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + chr(rng.choice((rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x1FFFF))))
        agrees(own, "".join(c for c in text if unicodedata.category(c) != "Cn"))


def test_lexicon_has_its_words_and_no_others():
    rng = random.Random(1)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(400)}
    ids = {w.encode(): [rng.randint(0, 60_000) for _ in range(rng.randint(1, 4))] for w in words}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(ids))
    for _ in range(3000):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))).encode()
        assert lexicon.get_many([word]) == [ids.get(word)]
    assert lexicon.get_many(list(ids)) == list(ids.values())
    assert bpe.Lexicon(bpe.compile_lexicon({})).get_many([b"a", b""]) == [None, None]


def test_equal_suffixes_are_one_state():
    words = [f"{c}ational" for c in "abcdefgh"]
    compiled = bpe.Lexicon(bpe.compile_lexicon({w.encode(): [k] for k, w in enumerate(words)}))
    assert len(compiled.final) == len("ational") + 2  # the start, and one chain for all
    assert compiled.get_many([w.encode() for w in words]) == [[k] for k in range(8)]


def test_table_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens, name = bpe.with_tokens(docs, PATH)
    for row in tokens.collect():
        assert list(row[name].ids) == LIBRARY.encode(row.text, add_special_tokens=False).ids
        assert row[name].decoded == LIBRARY.decode(list(row[name].ids), skip_special_tokens=False)


def test_odd_rows(spark, odd_docs, no_docs):
    tokens, name = bpe.with_tokens(odd_docs, PATH)
    assert name == "bpe_" and tokens.columns[:-1] == odd_docs.columns and tokens.count() == odd_docs.count()
    got = {r.doc_id: r[name] for r in tokens.collect() if r.doc_id in (3, 4, 5)}
    assert all(list(g.ids) == [] and g.decoded == "" for g in got.values())
    assert bpe.with_tokens(no_docs, PATH)[0].count() == 0


def test_rows_merge_like_single_pieces():
    rng = random.Random(4)
    pieces = ["".join(rng.choice("aehinorstthé日") for _ in range(rng.randint(1, 20))) for _ in range(2000)] + ["a" * 40, "x"]
    assert VOCABULARY.merge_many(pieces) == [VOCABULARY.merge(p) for p in pieces]
