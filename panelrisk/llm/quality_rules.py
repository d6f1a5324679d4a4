"""Quality rules: counts of symbols and lines, and repetition measured by suffix arrays.

The suffixes of many texts are sorted together, a text's number being the first "word" of each of its suffixes,
by prefix doubling: after round r suffixes are ranked by their first 2**r words, and only those still tied are
sorted again. The longest common prefix of neighbours comes from the rank tables of all rounds, largest step
first. A position lies in LCP intervals of depth up to m = max(prefix shared with the neighbour before, with the
neighbour after); the deepest of them is a repeated substring that cannot be extended to the right, so the union of
the spans [i, i + m) with m >= ``least_words`` is the union of all maximal repeated substrings of that length.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, blocks, free_name, hashed_words

SYMBOLS = "#*$%&|<>"

#: Texts of so many characters are sorted at a time; a longer text is a block of its own.
BLOCK_CHARS = 1_200_000

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Base: at least ``min_words`` words, at most ``max_repeat_pct`` percent in repeated 3-word windows.

    Method: repeats of ``least_words`` words or more cover at most ``max_covered_pct`` percent of the words, and no
    repeated substring is longer than ``max_longest_pct`` percent of the text (texts whose longest repeat stays
    under ``least_words`` pass).
    """

    min_words: int = 50
    max_repeat_pct: int = 50
    least_words: int = 6
    max_covered_pct: int = 50
    max_longest_pct: int = 40


def suffix_array(words: np.ndarray, texts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts in order, and the words each shares with the one before it (0 across texts).

    ``words``: any comparable numbers; ``texts``: the text of each word, ascending; ``ends``: where that text ends.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, inverse = np.unique(words, return_inverse=True)
    key = texts.astype(np.int64) * (len(distinct) + 1) + inverse
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    sizes = np.diff(np.r_[starts, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    tables = [rank.copy()]
    active = order[np.repeat(sizes > 1, sizes)]
    step = 1
    while len(active):
        far = active + step
        inside = far < ends[active]
        nxt = np.zeros(len(active), np.int64)
        nxt[inside] = rank[far[inside]] + 1
        key = rank[active] * (n + 1) + nxt
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        fresh = np.r_[True, key[1:] != key[:-1]]
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = old + first - group
        tables.append(rank.copy())
        tied = np.diff(np.r_[np.flatnonzero(fresh), len(active)])
        active = active[np.repeat(tied > 1, tied)]
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    shared = np.zeros(n, np.int64)
    pairs = np.flatnonzero(tables[0][sa[1:]] == tables[0][sa[:-1]]) + 1
    a, b = sa[pairs - 1], sa[pairs]
    end = ends[a]
    for r in range(len(tables) - 1, -1, -1):
        table = tables[r]
        ok = (a < end) & (b < end)
        same = ok.copy()
        same[ok] = table[a[ok]] == table[b[ok]]
        shared[pairs] += same << r
        a, b = a + (same << r), b + (same << r)
    return sa, shared


def repetition(words: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: words in repeated 3-word windows, words in repeats of ``least`` words or more, longest repeat.

    ``words``: hashes of the words of all texts in a row; ``lengths``: the number of words of each text.
    """
    windows, covered, longest = (np.zeros(len(lengths), np.int64) for _ in range(3))
    n = len(words)
    if not n:
        return windows, covered, longest
    texts = np.repeat(np.arange(len(lengths)), lengths)
    sa, shared = suffix_array(words, texts, np.cumsum(lengths)[texts])
    most = np.empty(n, np.int64)
    most[sa] = np.maximum(shared, np.r_[shared[1:], 0])

    def union(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + sizes, -1)
        return np.bincount(texts[np.cumsum(edge[:-1]) > 0], minlength=len(lengths))

    three = np.flatnonzero(most >= 3)
    windows += union(three, np.full(len(three), 3))
    long = np.flatnonzero(most >= least)
    covered += union(long, most[long])
    np.maximum.at(longest, texts, most)
    return windows, covered, longest


def measure(texts: list[str | None], rules: Rules) -> pd.DataFrame:
    """The columns of SCHEMA for whole texts; a null text counts as empty."""
    texts = [text or "" for text in texts]
    rows = []
    for text in texts:
        lines = [line for line in text.split("\n") if line.strip(BLANKS)]
        rows.append((len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))))
    out = pd.DataFrame(rows, columns=["word_chars", "n_symbols", "n_dup_lines"], dtype="int64")
    parts = []
    for a, b in blocks(map(len, texts), BLOCK_CHARS):
        words, lengths = hashed_words([text.encode() for text in texts[a:b]])
        parts.append((lengths, *repetition(words, lengths, rules.least_words)))
    for k, name in enumerate(("n_words", "n_repeat_words", "covered_words", "longest_repeat")):
        out[name] = np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
    out["base_failed"] = (out.n_words < rules.min_words) | (100 * out.n_repeat_words > rules.max_repeat_pct * out.n_words)
    repeats = out.longest_repeat >= rules.least_words
    out["kept"] = ~out.base_failed & ~(
        (100 * out.covered_words > rules.max_covered_pct * out.n_words)
        | (repeats & (100 * out.longest_repeat > rules.max_longest_pct * out.n_words))
    )
    return out


def with_quality(df: DataFrame, text: str = "text", rules: Rules = Rules(), into: str = "quality") -> tuple[DataFrame, str]:
    """Add one struct column with the fields of SCHEMA; returns the frame and the column's name.

    Every row stays, repeated rows and rows with null keys too. Null and empty texts have no words: all counts 0,
    base_failed, not kept. Other columns are untouched, and the new name gives way to one that is taken.
    """
    name = free_name(df, into)

    @F.pandas_udf(SCHEMA)
    def rule(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield measure(batch.tolist(), rules)

    return df.withColumn(name, rule(F.col(f"`{text}`").cast("string"))), name
