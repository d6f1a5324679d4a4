"""Byte-pair encoding and decoding with a lexicon compiled into a minimal acyclic transducer.

The words of all texts are counted in Spark. The most frequent ones and their ids become an automaton in which equal
suffixes are one state; each edge carries how many words sort before it, so a word's path adds up to its number, and
the number leads to its ids. The automaton is one file of flat arrays. Spark ships it to the executors,
where every task maps it into memory. Words outside the lexicon are merged exactly, so the lexicon's size
changes the speed and never the ids.

Normal form, splitting, merging and decoding are those of the vocabulary file: NFC, white space to spaces, lower case,
pieces with a word-end sign, and decoding as the tokens joined by spaces.
"""
from __future__ import annotations

import gc
import heapq
import json
import mmap
import re
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, free_name, shared_folder, written

#: Size of the lexicon: at most so many words of at most so many bytes, a few MB whatever the corpus.
LEXICON_WORDS, LEXICON_BYTES = 100_000, 64
#: Words and pieces remembered by a task, and characters encoded at a time.
CACHE_WORDS, BLOCK_CHARS = 300_000, 2_000_000
#: Pieces of up to so many bytes are merged as rows of an array, so many rows at a time; longer ones one by one.
MATRIX_BYTES, MATRIX_ROWS, _NO_RANK = 32, 20_000, 1 << 40

# Fixed value: how the vocabulary's words are split.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Token ids and merge ranks of a vocabulary file."""

    def __init__(self, content: str) -> None:
        data = json.loads(content)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.letters = byte_letters()
        #: Ids of single bytes inside a piece and at its end.
        self.inner = np.array([self.ids[c] for c in self.letters], np.int64)
        self.outer = np.array([self.ids[c + WORD_END] for c in self.letters], np.int64)
        #: Pairs of ids in order, with the rank and the id of what they merge to.
        keys = np.array([(self.ids[a] << 20) | self.ids[b] for a, b in model["merges"]], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[by], by.astype(np.int64)
        self.pair_ids = np.array([self.ids[a + b] for a, b in model["merges"]], np.int64)[by]
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # One letter at a time: lower() of a whole word would write a final sigma at its end.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def chunks(self, text: str) -> list[str]:
        """Special tokens as they are written, and what white space leaves between them; no piece reaches beyond one."""
        if self.special_pattern is not None and any(map(text.__contains__, self.special)):
            parts = self.special_pattern.split(text)
            return [c for k, part in enumerate(parts) for c in ([part] if k % 2 else self._apart(part))]
        return self._apart(text)

    @staticmethod
    def _apart(text: str) -> list[str]:
        if _SEPARATORS.search(text):  # split() takes these four for white space, the vocabulary's pattern doesn't
            return [c for c in regex.split(r"\s+", text) if c]
        return text.split()

    def pieces(self, chunk: str) -> list[str]:
        # Letters only, in normal form before and after: one piece, as the pattern would find.
        if chunk.isalpha() and "Σ" not in chunk and (lower := chunk.lower()).isalpha() and (lower.isascii() or unicodedata.is_normalized("NFC", chunk)):
            return [lower]
        return [chunk] if chunk in self.special else PIECE.findall(self.normal(chunk))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs of ids; _NO_RANK where they don't merge."""
        keys = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at], _NO_RANK), self.pair_ids[at]

    def merge_many(self, pieces: list[str]) -> list[list[int]]:
        """Ids of many pieces: in each, the adjacent pair of lowest rank, the leftmost of equals, is joined until none
        has a rank. Pieces of like length are rows of one array, and all rows take a step at a time."""
        encoded = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        out: list[list[int]] = [[]] * len(pieces)
        low = 0
        for high in (6, 10, 16, MATRIX_BYTES):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(rows, len(rows) // MATRIX_ROWS + 1):
                if len(part):
                    for k, ids in zip(part.tolist(), self._merge_rows([encoded[k] for k in part.tolist()], lengths[part])):
                        out[k] = ids
            low = high
        for k in np.flatnonzero(lengths > low).tolist():
            out[k] = self.merge(pieces[k])
        return out

    def _merge_rows(self, pieces: list[bytes], lengths: np.ndarray) -> list[list[int]]:
        width = int(lengths.max())
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        place = np.arange(width)
        ids = np.where(place < lengths[:, None], self.inner[data], -1)
        every = np.arange(len(pieces))
        ids[every, lengths - 1] = self.outer[data[every, lengths - 1]]
        ranks, merged = (self._pairs(ids[:, :-1], ids[:, 1:]) if width > 1 else (np.zeros((len(pieces), 0)),) * 2)
        active = every if width > 1 else every[:0]
        while len(active):
            own, least = ids[active], ranks[active].argmin(axis=1)
            some = ranks[active, least] < _NO_RANK
            active, own, least = active[some], own[some], least[some]
            if not len(active):
                break
            at = np.arange(len(active))
            own[at, least] = merged[active, least]
            source = np.minimum(place + (place > least[:, None]), width - 1)
            own = np.take_along_axis(own, source, axis=1)
            own[:, -1] = -1
            pair_source = source[:, :-1].clip(max=width - 2)
            new_ranks, new_merged = (np.take_along_axis(x[active], pair_source, axis=1) for x in (ranks, merged))
            new_ranks[:, -1] = _NO_RANK
            for shift in (-1, 0):  # only the pairs beside the new symbol are others than before
                pair = least + shift
                inside = np.flatnonzero((pair >= 0) & (pair < width - 1))
                new_ranks[inside, pair[inside]], new_merged[inside, pair[inside]] = self._pairs(own[inside, pair[inside]], own[inside, pair[inside] + 1])
            ids[active], ranks[active], merged[active] = own, new_ranks, new_merged
        counts = (ids >= 0).sum(axis=1).tolist()
        return [row[:n] for row, n in zip(ids.tolist(), counts)]

    def merge(self, piece: str) -> list[int]:
        """The same for one piece of any length, with the pairs in a queue."""
        parts = [self.letters[b] for b in piece.encode()]
        parts[-1] += WORD_END
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.ranks[pair], k) for k, pair in enumerate(pairwise(parts)) if pair in self.ranks]
        heapq.heapify(queue)
        while queue:
            rank, k = heapq.heappop(queue)
            if parts[k] is None or after[k] >= n or self.ranks.get((parts[k], parts[after[k]])) != rank:
                continue
            gone = after[k]
            parts[k] += parts[gone]
            parts[gone] = None
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
                if (new := self.ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(queue, (new, k))
            if before[k] >= 0 and (new := self.ranks.get((parts[before[k]], parts[k]))) is not None:
                heapq.heappush(queue, (new, before[k]))
        return [self.ids[p] for p in parts if p is not None]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The words and their ids as one block of arrays: the automaton, then the ids of each word by its number.

    Words are added in order; a state that the next word can't reach any more is replaced by an equal one, if there
    is one, so that no two states accept the same endings.
    """
    words = sorted(entries)
    children: list[list[tuple[int, int]]] = [[]]  # of a state: (byte, state), ascending
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # the last word: (state, byte) from the start
    tip, last = 0, b""

    def settle(depth: int) -> None:
        """Replace or register the states of the last word below the depth."""
        nonlocal tip
        while len(path) > depth:
            parent, byte = path.pop()
            key = (final[tip], tuple(children[tip]))
            same = register.setdefault(key, tip)
            children[parent].append((byte, same))
            tip = parent

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        for byte in word[common:]:
            path.append((tip, byte))
            children.append([])
            final.append(False)
            tip = len(children) - 1
        final[tip] = True
        last = word
    settle(0)

    number, order = {0: 0}, [0]
    for state in order:
        for _, child in children[state]:
            if child not in number:
                number[child] = len(order)
                order.append(child)
    endings: dict[int, int] = {}
    todo = [(0, False)]
    while todo:
        state, done = todo.pop()
        if state in endings:
            continue
        if done:
            endings[state] = final[state] + sum(endings[c] for _, c in children[state])
        else:
            todo += [(state, True), *((c, False) for _, c in children[state])]
    edges, targets, skips = array("I"), array("I"), array("I")
    for state in order:
        passed = int(final[state])
        for byte, child in children[state]:
            edges.append(number[state] << 8 | byte)
            targets.append(number[child])
            skips.append(passed)
            passed += endings[child]
    ends = np.cumsum([0] + [len(entries[w]) for w in words]).astype(np.uint32)
    ids = np.fromiter(chain.from_iterable(entries[w] for w in words), np.uint32)
    parts = [edges.tobytes(), targets.tobytes(), skips.tobytes(), ends.tobytes(), ids.tobytes(), bytes(final[s] for s in order)]
    return np.array([len(p) for p in parts], np.uint64).tobytes() + b"".join(parts)


class Lexicon:
    """A compiled lexicon over any buffer, such as a mapped file: edges (state and byte, in order), where each leads and
    how many words it passes; the end of each word's ids, the ids, and which states are final."""

    def __init__(self, buffer) -> None:
        sizes = np.frombuffer(buffer, np.uint64, 6)
        ends = np.cumsum([48, *sizes.tolist()]).tolist()
        parts = [np.frombuffer(buffer, np.uint8 if k == 5 else np.uint32, (z - a) // (1 if k == 5 else 4), a) for k, (a, z) in enumerate(pairwise(ends))]
        self.edges, self.targets, self.skips, self.ends, self.ids, self.final = parts

    @staticmethod
    def mapped(path: str) -> "Lexicon":
        with open(path, "rb") as file:
            return Lexicon(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def get_many(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of the words that the lexicon has, None for others; all words follow their edges together."""
        out: list[list[int] | None] = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        active = np.flatnonzero((lengths <= LEXICON_BYTES) & (lengths > 0)) if len(self.edges) else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number = (np.zeros(len(words), np.int64) for _ in range(2))
        step = 0
        while len(active):
            key = state[active] << 8 | data[starts[active] + step]
            edge = np.minimum(np.searchsorted(self.edges, key.astype(np.uint32)), len(self.edges) - 1)
            there = self.edges[edge] == key
            active, edge = active[there], edge[there]
            number[active] += self.skips[edge]
            state[active] = self.targets[edge]
            step += 1
            done = lengths[active] == step
            words_done = active[done][self.final[state[active[done]]] == 1]
            bounds = self.ends[number[words_done]].tolist(), self.ends[number[words_done] + 1].tolist()
            for k, a, z in zip(words_done.tolist(), *bounds):
                out[k] = self.ids[a:z].tolist()
            active = active[~done]
        return out


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles meanwhile: lists of ids form none, and each search would visit all that are remembered."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


@lru_cache(maxsize=2)
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


class Encoder:
    """Ids of what stands between white space, remembered, as are the ids of pieces; both in bounded number."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.chunks: dict[str, list[int]] = {}
        self.pieces: dict[str, list[int]] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces: of special tokens, else from the lexicon, else by merging."""
        special = self.vocabulary.special
        self.pieces.update((p, [special[p]]) for p in pieces if p in special)
        pieces = [p for p in pieces if p not in special]
        known = self.lexicon.get_many([p.encode() for p in pieces])
        self.pieces.update((p, ids) for p, ids in zip(pieces, known) if ids is not None)
        unseen = [p for p, ids in zip(pieces, known) if ids is None]
        self.pieces.update(zip(unseen, self.vocabulary.merge_many(unseen)))

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        parts = [self.vocabulary.chunks(t) for t in texts]
        new = {c: self.vocabulary.pieces(c) for c in set(chain.from_iterable(parts)).difference(self.chunks)}
        self._learn(list(set(chain.from_iterable(new.values())).difference(self.pieces)))
        of_piece = self.pieces.__getitem__
        self.chunks.update((c, of_piece(p[0]) if len(p) == 1 else list(chain.from_iterable(map(of_piece, p)))) for c, p in new.items())
        of_chunk = self.chunks.__getitem__
        return [list(chain.from_iterable(map(of_chunk, own))) for own in parts]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def default_vocabulary() -> str:
    """The place of the public vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(name: str) -> list[Column]:
    """n_tokens and the digests of the ids, as decimals joined by a space, and of the decoded text."""
    ids, decoded = F.col(name)["ids"], F.col(name)["decoded"]
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    ]


def frequent_pieces(df: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """(piece, n): the most frequent pieces, counted over all texts; as many as have at least the count from which on
    LEXICON_WORDS are not exceeded. Pieces that occur once are not worth a place."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _vocabulary(shared.value)
        for batch in batches:
            chunks: Counter[str] = Counter()
            for t in batch["text"]:
                if t:
                    chunks.update(own.chunks(t))
            found: Counter[str] = Counter()
            with uncollected():
                for chunk, n in chunks.items():
                    for piece in own.pieces(chunk):
                        found[piece] += n
            kept = [(p, n) for p, n in found.items() if len(p.encode()) <= LEXICON_BYTES and p not in own.special]
            yield pd.DataFrame(kept, columns=["piece", "n"]).astype({"piece": object, "n": "int64"})

    counts = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInPandas(count, "piece string, n long")
    counts = written(counts.groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1"), "pieces")
    # Counts are rounded to two binary digits, so their histogram has a few hundred rows at most.
    rounded = F.floor(2 * F.log2("n")).cast("int")
    least, total = 1 << 30, 0
    for row in sorted(counts.groupBy(rounded.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True):
        total += row["words"]
        if total > LEXICON_WORDS:
            break
        least = row["size"]
    return counts.filter(rounded >= least)


def publish(spark: SparkSession, content: bytes) -> str:
    """Put a file into the shared folder and have Spark ship it to every executor; returns its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString())
    return name


def with_tokens(df: DataFrame, vocabulary_path: str, text: str = "text", into: str = "bpe") -> tuple[DataFrame, str]:
    """Add a struct of ids and decoded: the ids of the whole text, and the text that the ids decode to.

    Null texts are like empty ones: no ids, decoded empty. Every row stays, other columns are untouched. Counting the
    lexicon reads the table once when this is called, encoding reads it once more.
    """
    spark = df.sparkSession
    name = free_name(df, into)
    content = read_vocabulary(vocabulary_path)
    own = _vocabulary(content)
    frequent = [row["piece"] for row in frequent_pieces(df, text, content).select("piece").collect()]
    file = publish(spark, compile_lexicon(dict(zip([p.encode() for p in frequent], own.merge_many(frequent)))))
    shared = spark.sparkContext.broadcast(content)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(shared.value)
        encoder = Encoder(vocabulary, Lexicon.mapped(SparkFiles.get(file)))
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch), 0).to_pylist()
            for a, b in blocks(lengths, BLOCK_CHARS):
                with uncollected():
                    ids = encoder.encode_many([t or "" for t in batch[a:b].to_pylist()])
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, count=int(ends[-1])))
                    decoded = pa.array(list(map(vocabulary.decode, ids)), pa.string())
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), flat), decoded], ["ids", "decoded"])

    return df.withColumn(name, encode(F.col(f"`{text}`").cast("string"))), name
