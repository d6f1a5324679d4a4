import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ids that share or lack a text, clashing names."""
    rows = [
        (1, "alpha beta gamma delta", "en", 5), (1, "alpha beta gamma delta", "en", 5), (2, "Alpha beta gamma delta", None, None), (3, None, "en", 1), (4, "", "en", 1),
        (None, "alpha beta gamma delta", "en", 5), (5, " \n\t ", "en", 1), (6, "word " * 30_000, "en", 1), (6, "another text under the same id", "en", 1), (None, None, None, None),
    ]
    names = "quality fingerprint fp leaks pii bpe score licenses tokens kept n text_id key seed component_id"
    kinds = ", ".join(f"{n} string" for n in names.split())
    return spark.createDataFrame([(*r, *("x" * len(names.split()))) for r in rows], f"doc_id long, text string, lang string, n_chars long, {kinds}")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
