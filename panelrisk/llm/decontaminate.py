"""Benchmark decontamination: size-partitioned MinHash search for contained items, then exact containment.

Items are put into classes by length, each with an upper bound u of shingles. For a class, a document is read as
overlapping windows of 2u shingles, a step of u apart, so an item's passage lies whole inside one window whose size is
at most a fixed multiple of the item's: containment of the item then is bounded below as similarity to that window.
Windows and items get one-permutation MinHash signatures (``BINS`` bins of one hash), and one equal bin makes an item a
candidate. Items of up to ``CLASS_LEAST`` shingles are too short for a signature to be sure to find them: each of their
shingles is a bin of its own. Candidates are verified by exact containment: the share of the item's distinct shingles that the whole
document has. Windows are made of the minima of two neighbouring steps, so a shingle is hashed once per document.

The items, not the documents, travel: one block of at most ``ITEM_BYTES`` of item text at a time is sent to
the tasks, and the documents are read once for each block. Items of fewer than five words are one shingle each.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_text, free_name, hashed_words, shingle_hashes

WORDS = 5
CONTAINED = 0.8
BINS = 128
#: A class holds items of more than bound / CLASS_STEP and at most bound shingles.
CLASS_LEAST, CLASS_STEP = 16, 4
ITEM_BYTES = 32_000_000
_NONE = np.uint64(2**64 - 1)
_SEEN = (1 << 20) - 1
#: Texts of so many characters are searched at a time.
BLOCK_CHARS = 1_200_000

#: Lower case, and every ASCII character that is neither letter nor digit is a blank.
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and how many each text has."""
    return hashed_words([(text or "").lower().encode() for text in texts], _PLAIN)


def class_bound(shingles: int) -> int:
    bound = CLASS_LEAST
    while bound < shingles:
        bound *= CLASS_STEP
    return bound


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash in each bin; the bin is a hash's upper bits."""
    out = np.full(BINS, _NONE)
    np.minimum.at(out, (hashes >> np.uint64(57)).astype(np.int64), hashes)
    return out


class Items:
    """A block of benchmark items, ready for the search."""

    def __init__(self, rows: list[tuple]) -> None:
        """``rows``: (item_id, text); items without words match nothing and are left out."""
        self.ids, self.shingles, self.width = [], [], []
        held: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for (item, _), words in zip(rows, by_text(*words_of([text for _, text in rows]))):
            if not len(words):
                continue
            width = min(WORDS, len(words))
            shingles, _ = shingle_hashes(words, np.array([len(words)]), width)
            number = len(self.ids)
            self.ids.append(item)
            self.width.append(width)
            self.shingles.append(np.unique(shingles))
            bound = class_bound(len(shingles))
            bins = self.shingles[-1] if bound == CLASS_LEAST else signature(self.shingles[-1])
            held.setdefault((width, bound), []).append((bins, number))
        #: width -> class bound -> sorted bin values and the item of each; a value's bin shows in its upper bits.
        self.classes: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        #: width -> which lower bits some bin value of that width has.
        self.seen: dict[int, np.ndarray] = {}
        for (width, bound), found in held.items():
            values = np.concatenate([s for s, _ in found])
            numbers = np.repeat([n for _, n in found], [len(s) for s, _ in found])
            some = values != _NONE
            by = np.argsort(values[some], kind="stable")
            self.classes.setdefault(width, {})[bound] = (values[some][by], numbers[some][by])
            seen = self.seen.setdefault(width, np.zeros(_SEEN + 1, bool))
            seen[(values[some] & np.uint64(_SEEN)).astype(np.int64)] = True

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text (item_id, containment, shared, shingles) of the items that it contains."""
        out: list[list[tuple]] = [[] for _ in texts]
        words, lengths = words_of(texts)
        for width, classes in self.classes.items():
            hashes, counts = shingle_hashes(words, lengths, width)
            possible = np.flatnonzero(self.seen[width][hashes & np.uint64(_SEEN)])
            ends = np.cumsum(counts)
            for number in np.unique(np.searchsorted(ends, possible, side="right")):
                own = hashes[ends[number] - counts[number] : ends[number]]
                candidates: set[int] = set()
                for bound, (values, numbers) in classes.items():
                    candidates.update(self._candidates(own, bound, values, numbers).tolist())
                out[number] += self._contained(sorted(candidates), np.unique(own))
        return out

    def _contained(self, candidates: list[int], document: np.ndarray) -> list[tuple]:
        """Of the candidates those of whose distinct shingles the document has enough."""
        out = []
        for number in candidates:
            own = self.shingles[number]
            shared = int(np.isin(own, document, assume_unique=True).sum())
            if shared >= CONTAINED * len(own):
                out.append((self.ids[number], shared / len(own), shared, len(own)))
        return out

    @staticmethod
    def _candidates(hashes: np.ndarray, bound: int, values: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Items with a bin equal to that of a window of 2 * bound shingles."""
        # A bin's minimum of a window is a hash of the document: only those that some item has as a minimum matter.
        at = np.searchsorted(values, hashes)
        at[at == len(values)] = 0
        hit = np.flatnonzero(values[at] == hashes)
        if not len(hit):
            return numbers[:0]
        if bound == CLASS_LEAST:
            return Items._with_bins(np.unique(hashes[hit]), values, numbers)
        step = np.arange(len(hashes)) // bound
        near = np.unique(step[hit])
        near = np.unique(np.r_[near - 1, near, near + 1])
        used = np.flatnonzero(np.isin(step, near))
        slot, step_used = np.unique(step[used], return_inverse=True)
        least = np.full((len(slot), BINS), _NONE)
        np.minimum.at(least, (step_used, (hashes[used] >> np.uint64(57)).astype(np.int64)), hashes[used])
        follow = np.flatnonzero(np.diff(slot) == 1)
        windows = np.concatenate([np.minimum(least[follow], least[follow + 1]), least[np.isin(slot, [0, step[-1]])]])
        return Items._with_bins(np.unique(windows), values, numbers)

    @staticmethod
    def _with_bins(found: np.ndarray, values: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Items that have one of the found values in a bin."""
        low, high = np.searchsorted(values, found), np.searchsorted(values, found, side="right")
        return np.concatenate([numbers[a:b] for a, b in zip(low, high) if a < b] or [numbers[:0]])


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The items, a block of bounded size at a time; blocks are cut by a hash of the item."""
    items = items.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, ceil(total / ITEM_BYTES))
    for block in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block)
        rows = [tuple(r) for r in part.distinct().collect()]
        if rows or count == 1:
            yield rows


def with_leaks(df: DataFrame, items: DataFrame, text: str = "text", key: str = "item_id", into: str = "leaks") -> tuple[DataFrame, str]:
    """Add an array of (item, containment, shared, shingles), one for each item of which the text has
    ``CONTAINED`` of the distinct five-word shingles or more; by item, empty where there is none.

    Every row stays. Null and empty texts contain nothing; null and empty items are in nothing; repeated items
    count once, and items that share an id but not the text are one entry each. Item ids are whole numbers or null.
    """
    name = free_name(df, into)
    context = df.sparkSession.sparkContext
    parts = [_search(context.broadcast(Items(rows)))(F.col(f"`{text}`").cast("string")) for rows in item_blocks(items, key, "text")]
    return df.withColumn(name, F.array_sort(parts[0] if len(parts) == 1 else F.flatten(F.array(*parts)))), name


def _search(shared):
    """The search for one block of items as a function of a text column."""

    @F.pandas_udf("array<struct<item:long,containment:double,shared:long,shingles:long>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item", "containment", "shared", "shingles")
        for batch in batches:
            texts = batch.tolist()
            found = [x for a, b in blocks((len(t or "") for t in texts), BLOCK_CHARS) for x in shared.value.find(texts[a:b])]
            yield pd.Series([[dict(zip(names, leak)) for leak in leaks] for leaks in found], dtype=object)

    # A filter or an explode over the result would otherwise be pushed below it and run the search a second time.
    return search.asNondeterministic()
