"""Alignment of two tokenizers: where both end a token, the text is cut into groups of tokens that stand for each other.

Texts are encoded by a byte-level vocabulary (A) and a piece vocabulary (B). The byte ends of both are compared by
divide and conquer: a stretch between two known cuts is searched for a common end near its middle, by bisecting the
ends of B; there it falls into two stretches, which are searched alike. A stretch without a common end inside is a
group. All stretches of one depth, of many texts, are searched side by side as arrays.

The first cuts are those before words, where both vocabularies surely end a token; a word that a task has seen before
is neither encoded nor searched again.

A token of A and one of B are linked where their bytes overlap. How often two ids are linked in the whole corpus is
counted by Spark: texts are encoded once, in blocks of a few megabytes; a block keeps a list of its different words and
links and each document points into that list, so what is shuffled are the lists, and no table of all links is broadcast.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, free_name, written

#: Bytes of text that share a list of links.
BLOCK_BYTES = 1 << 22
#: Chunks whose groups a task keeps, and their characters.
KEPT = 150_000
KEPT_CHARS = 1 << 24
#: Tokens on each side of a middle that are tried one by one.
NEAR = 16
#: What stands for a space in B's pieces.
MARK = "▁"


def default_paths() -> tuple[str, str]:
    """The places of the public byte-level and piece vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself, or one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both vocabularies: how they encode, and the bytes of each of their ids."""

    def __init__(self, a_file: bytes, b_file: bytes) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        alphabet, described = byte_alphabet(), json.loads(a_file)
        added = {t["id"] for t in described.get("added_tokens", [])}
        entries = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [
            b"" if i not in entries else entries[i].encode() if i in added else bytes(alphabet[c] for c in entries[i])
            for i in range(max(entries) + 1)
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        # A token's id and what stands after it in the rendering of the groups: inside a group, and at its end.
        texts = [str(i) + after for after in (",", "|") for i in range(len(self.a_bytes))]
        texts += [str(i) + after for after in (",", ";") for i in range(len(self.b_bytes))]
        self.rendered = np.array(texts, object)
        # Both end a token before a single space and a word: A's pattern gives the space to the word, whatever stands
        # before it, and no piece of B goes on after a space that follows other characters.
        split = described.get("pre_tokenizer") or {}
        plain = described.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.cuts_at_words = bool(plain) and not any(MARK in p.lstrip(MARK) for p in pieces)

    def chunks(self, text: str) -> list[str]:
        """Parts of a text, each without the space before it, at whose borders both vocabularies surely end a token."""
        return _WORD.split(text) if self.cuts_at_words else [text]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for a space and each text; both empty unless the tokens' bytes are exactly that."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        for k, text in enumerate(texts):
            whole = b" " + text.encode()
            if not text or b"".join([a_bytes[i] for i in a[k]]) != whole or b"".join([b_bytes[i] for i in b[k]]) != whole:
                a[k], b[k] = [], []
        return a, b


#: A space between a character that is none and a word.
_WORD = re.compile(r" (?=\S)(?<=[^ ] )")


@lru_cache(maxsize=1)
def _tokenizers(a_file: bytes, b_file: bytes) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def _is_end(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each position is one of the sorted ends, by bisecting them."""
    found = np.minimum(np.searchsorted(ends, at), len(ends) - 1)
    return ends[found] == at


def cut_ends(a_ends: np.ndarray, b_ends: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tokens of A at whose end a token of B ends too, in order.

    ``last`` are tokens of A known to be such cuts, the last token among them: the stretches between them are where
    the search begins. In each stretch the token in the middle is tried, then its neighbours one by one, and from
    ``NEAR`` on those up to twice as far, and so on; the nearest hit halves the stretch.
    """
    cuts = [last]
    low, high = np.r_[0, last[:-1] + 1], last
    while True:
        open_ = high > low  # the token at ``high`` is a cut already
        low, high = low[open_], high[open_]
        if not len(low):
            break
        middle = (low + high - 1) // 2
        hit = np.where(_is_end(b_ends, a_ends[middle]), middle, -1)
        waiting, reach = np.flatnonzero((hit < 0) & (high - low > 1)), 0
        while len(waiting):
            m, first, stop = middle[waiting], low[waiting], high[waiting] - 1
            if reach < NEAR:
                reach += 1
                for tokens, inside in ((m + reach, m + reach <= stop), (m - reach, m - reach >= first)):
                    which = np.flatnonzero(inside & (hit[waiting] < 0))
                    found = which[_is_end(b_ends, a_ends[tokens[which]])]
                    hit[waiting[found]] = tokens[found]
            else:
                for k, (i, a, z) in enumerate(zip(waiting, np.maximum(first, m - 2 * reach), np.minimum(stop, m + 2 * reach))):
                    tokens = np.r_[m[k] + reach + 1 : z + 1, a : m[k] - reach]
                    tokens = tokens[_is_end(b_ends, a_ends[tokens])]
                    if len(tokens):
                        hit[i] = tokens[np.argmin(np.abs(tokens - m[k]))]
                reach *= 2
            waiting = waiting[(hit[waiting] < 0) & ((m + reach < stop) | (m - reach > first))]
        found = hit >= 0
        low, high, hit = low[found], high[found], hit[found]
        cuts.append(hit)
        low, high = np.stack([low, hit + 1], 1).ravel(), np.stack([hit, high], 1).ravel()
    return np.sort(np.concatenate(cuts))


class Groups:
    """The groups of several texts, whose tokens stand in a row.

    ``links`` are pairs of ids, A's in the upper half; ``link_stops`` is where the links of each text end.
    """

    def __init__(self, tokenizers: Tokenizers, a: list[list[int]], b: list[list[int]]) -> None:
        self.tokenizers = tokenizers
        self.n_a, self.n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a, b))
        self.a, self.b = (np.array([i for ids in side for i in ids], np.int64) for side in (a, b))
        self.a_stops, self.b_stops = np.cumsum(self.n_a), np.cumsum(self.n_b)
        a_ends, b_ends = np.cumsum(tokenizers.a_sizes[self.a]), np.cumsum(tokenizers.b_sizes[self.b])
        if not len(self.a):
            self.a_cuts = self.b_cuts = self.links = self.link_stops = np.zeros(0, np.int64)
            self.n_groups = self.n_links = np.zeros(len(a), np.int64)
            self.link_stops = self.n_links
            return
        self.a_cuts = cut_ends(a_ends, b_ends, self.a_stops[self.n_a > 0] - 1)
        self.b_cuts = np.searchsorted(b_ends, a_ends[self.a_cuts])
        self.n_groups = np.diff(np.searchsorted(self.a_cuts, np.r_[0, self.a_stops]))
        # Every byte where a token of either ends is the end of one overlap, so of one link.
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two runs to merge
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]]
        self.links = self.a[np.searchsorted(a_ends, ends)] << 32 | self.b[np.searchsorted(b_ends, ends)]
        self.n_links = self.n_a + self.n_b - self.n_groups
        self.link_stops = np.cumsum(self.n_links)

    def rendered(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text: ids of A and B in order, groups apart by semicolons."""
        t = self.tokenizers
        a_last, b_last = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_last[self.a_cuts], b_last[self.b_cuts] = True, True
        a_before = np.r_[0, np.cumsum(a_last)[:-1]][: len(self.a)]
        b_before = np.r_[0, np.cumsum(b_last)[:-1]][: len(self.b)]
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + np.r_[0, self.b_cuts + 1][a_before]] = self.a + a_last * len(t.a_bytes)
        codes[np.arange(len(self.b)) + (self.a_cuts + 1)[b_before]] = 2 * len(t.a_bytes) + self.b + b_last * len(t.b_bytes)
        parts = t.rendered[codes]
        stops = self.a_stops + self.b_stops
        return ["".join(parts[i:j])[:-1] for i, j in zip(np.r_[0, stops[:-1]], stops)]

    def lists(self) -> list[list[dict]]:
        """The groups of each text as lists of ids."""
        out, stops = [], np.searchsorted(self.a_cuts, self.a_stops)
        a_from, b_from = np.r_[0, self.a_cuts + 1], np.r_[0, self.b_cuts + 1]
        for k, n in enumerate(self.n_groups):
            each = range(stops[k] - n, stops[k])
            out.append([{"a": self.a[a_from[g] : a_from[g + 1]].tolist(), "b": self.b[b_from[g] : b_from[g + 1]].tolist()} for g in each])
        return out


class Chunks:
    """Chunks seen so far and what is known of their groups; emptied between blocks when it has grown to KEPT."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.tokenizers = tokenizers
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.size = 0
        self.figures = np.zeros((0, 5), np.int64)  # valid, n_a, n_b, n_groups, n_links
        self.texts = np.zeros(0, object)
        self.links, self.stops = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, chunks: list[str]) -> np.ndarray:
        """The place of each of several different chunks; new ones are encoded and cut into groups."""
        if len(self.places) > KEPT or self.size > KEPT_CHARS:
            self._clear()
        new = [c for c in chunks if c not in self.places]
        if new:
            self.size += sum(map(len, new))
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            g = Groups(self.tokenizers, *self.tokenizers.encode(new))
            figures = np.stack([(g.n_a > 0).astype(np.int64), g.n_a, g.n_b, g.n_groups, g.n_links], 1)
            texts = np.empty(len(new), object)
            texts[:] = g.rendered()
            self.stops = np.r_[self.stops, len(self.links) + g.link_stops]
            self.figures, self.texts, self.links = np.r_[self.figures, figures], np.r_[self.texts, texts], np.r_[self.links, g.links]
        return np.fromiter((self.places[c] for c in chunks), np.int64, len(chunks))


def with_groups(df: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, into: str = "groups") -> tuple[DataFrame, str]:
    """Add the groups of each text: an array of structs with the ids of A and of B, in order.

    Null and empty texts, and texts that either vocabulary changes, have an empty array. Every row stays.
    """
    name = free_name(df, into)
    shared = _shared(df, paths)

    @F.pandas_udf("array<struct<a:array<int>,b:array<int>>>")
    def groups(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizers = _tokenizers(*shared.value)
        for batch in batches:
            texts, out = batch.fillna("").tolist(), []
            for i, j in blocks((len(t) + 1 for t in texts), BLOCK_BYTES):
                out += Groups(tokenizers, *tokenizers.encode(texts[i:j])).lists()
            yield pd.Series(out, dtype=object)

    return df.withColumn(name, groups(F.col(f"`{text}`").cast("string"))), name


def _shared(df: DataFrame, paths: tuple[str, str] | None):
    """Both vocabulary files, a few megabytes, on every executor."""
    contents = []
    for path in paths or default_paths():
        with open(path, "rb") as file:
            contents.append(file.read())
    return df.sparkSession.sparkContext.broadcast(tuple(contents))


_ALIGNED = pa.schema(
    [("id", pa.string())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("block", pa.int64())]
    + [(c, pa.list_(kind)) for c, kind in (("at", pa.int32()), ("times", pa.int32()), ("pairs", pa.int64()), ("counts", pa.int64()), ("chunk_links", pa.int32()), ("chunk_stops", pa.int32()))]
)
_ALIGNED_ROWS = (
    "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, at array<int>, times array<int>, "
    "pairs array<long>, counts array<long>, chunk_links array<int>, chunk_stops array<int>"
)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of each range, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def _aligned_block(kept: Chunks, ids: pa.Array, texts: list[str], block: int) -> dict:
    """The documents of a block with their figures, and their chunks as places in the block's list of chunks.

    Its lists stand in the first row: the different links, how many of each kind the block has, and the places of the
    links of each chunk.
    """
    seen: dict[str, int] = {}
    coded = [np.array([seen.setdefault(w, len(seen)) for w in kept.tokenizers.chunks(t)], np.int32) for t in texts]
    sizes, codes = np.array([len(c) for c in coded], np.int64), np.concatenate(coded)
    different = list(seen)
    places = kept.look_up(different)
    del coded, seen
    owner = np.repeat(np.arange(len(texts)), sizes)
    # A text that one of its chunks makes invalid has no tokens.
    valid = np.bincount(owner, weights=kept.figures[places, 0][codes] == 0, minlength=len(texts)) == 0
    figures = np.zeros((len(texts), 4), np.int64)
    for k in range(4):
        figures[:, k] = np.bincount(owner, weights=kept.figures[places, 1 + k][codes], minlength=len(texts)) * valid
    rendered, stops = kept.texts[places[codes]], np.cumsum(sizes)
    digests = [hashlib.sha256(";".join(rendered[i:j]).encode()).hexdigest() if ok else "" for i, j, ok in zip(stops - sizes, stops, valid)]

    taken = valid[owner]
    both, times = np.unique(owner[taken] << 32 | codes[taken], return_counts=True)
    cuts = np.searchsorted(both >> 32, np.arange(1, len(texts)))
    n_links = kept.figures[places, 4]
    links = kept.links[_ranges(kept.stops[places] - n_links, n_links)]
    pairs, at = np.unique(links, return_inverse=True)
    counts = np.bincount(at, weights=np.repeat(np.bincount(codes[taken], minlength=len(different)), n_links), minlength=len(pairs)).astype(np.int64)
    rest = [None] * (len(texts) - 1)
    return {
        "id": ids, "n_a": figures[:, 0], "n_b": figures[:, 1], "n_groups": figures[:, 2], "n_links": figures[:, 3], "groups_sha256": digests, "block": np.full(len(texts), block),
        "at": np.split((both & 0xFFFFFFFF).astype(np.int32), cuts), "times": np.split(times.astype(np.int32), cuts), "pairs": [pairs, *rest], "counts": [counts, *rest],
        "chunk_links": [at.astype(np.int32), *rest], "chunk_stops": [np.cumsum(n_links).astype(np.int32), *rest],
    }


def _aligned_blocks(shared):
    """Reads (id, text) and writes the documents of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Chunks(_tokenizers(*shared.value))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            for i, j in blocks((n + 1 for n in sizes.to_pylist()), BLOCK_BYTES):
                ids, texts = (batch.column(c).slice(i, j - i) for c in ("id", "text"))
                yield from pa.Table.from_pydict(_aligned_block(kept, ids, pc.fill_null(texts, "").to_pylist(), block), _ALIGNED).to_batches()
                block += 1

    return run


def _scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Documents of one block with the figures of their links, added up for each chunk of the block's list."""
    lists = left[left["chunk_stops"].notna()].iloc[0]
    links, stops = lists["chunk_links"], np.asarray(lists["chunk_stops"], np.int64)
    out = left[["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
    for column in ("best", "total"):
        values = np.zeros(int(right["place"].max()) + 1 if len(right) else 0, np.int64)
        values[right["place"]] = right[column]
        sums = np.r_[0, np.cumsum(values[links])][stops]
        each = np.diff(sums, prepend=0)
        out["n_best" if column == "best" else "count_sum"] = [int((each[a] * t).sum()) for a, t in zip(left["at"], left["times"])]
    return out


def alignments(df: DataFrame, id_column: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``df``.

    n_links: pairs of a token of A and one of B whose bytes overlap. n_best: links whose pair of ids is linked in the
    whole corpus as often as the B id's most frequent pair, ties included. count_sum: how often the pair of each link
    is linked in the corpus, added up. Null and empty texts, and texts that either vocabulary changes, have zeros and
    an empty digest. Repeated rows count as often as they stand there, ids may be null; other columns are not read.
    """
    kind = df.schema[id_column].dataType
    # As text, ids keep every digit beside nulls.
    rows = df.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    aligned = written(rows.mapInArrow(_aligned_blocks(_shared(df, paths)), _ALIGNED_ROWS), "alignment")

    listed = aligned.filter(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "counts")).alias("l"))
    totals = written(listed.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.counts").alias("total")), "links")
    most = totals.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("total").alias("most"))
    judged = totals.join(most, totals["pair"].bitwiseAND(0xFFFFFFFF) == most["b"])
    judged = judged.select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))

    places = aligned.filter(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("place", "pair"))
    values = places.join(judged, "pair").select("block", "place", "total", "best")
    values = values.withColumnRenamed("block", "of")
    figures = aligned.drop("pairs", "counts")
    scored = figures.groupBy("block").cogroup(values.groupBy("of")).applyInPandas(_scored, "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return scored.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_column)
