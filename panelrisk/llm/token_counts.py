"""Token counts of fields and sections, attributed through offsets.

A document's fields are put one below the other and encoded once, as one text, because encoding the parts would give
other tokens at their borders. A token's byte span follows from the lengths of the tokens before it. Spans of tokens
and of sections are joined as intervals, both in order, and a token that crosses a border is given away by rule:

- "first": to the section that has its first byte,
- "majority": to the section that has most of its bytes, of equal ones the first,
- "split": to each section in proportion to its bytes there.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

RULES = ("first", "majority", "split")
#: What stands between fields; its tokens are counted as those of the field before it.
BORDER = "\n"


def default_vocabulary() -> str:
    """The place of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """A byte-level vocabulary and the length in bytes of each of its tokens."""

    def __init__(self, content: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Where each token of the whole text ends, in bytes of its UTF-8 form."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The code points of each token, first to last exclusive; tokens that share a character both have it."""
        ends = self.ends(text)
        first_bytes = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        begin = np.searchsorted(first_bytes, np.r_[0, ends[:-1]], side="right") - 1
        return list(zip(begin.tolist(), np.searchsorted(first_bytes, ends, side="left").tolist()))


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a border.

    ``ends``: of the tokens; ``borders``: the ends of the sections, the last one equal to the last token's end.
    Empty sections get nothing.
    """
    counts = np.zeros(len(borders))
    if not len(ends):
        return counts, 0
    starts = np.r_[0, ends[:-1]]
    first = np.searchsorted(borders, starts, side="right")
    last = np.searchsorted(borders, ends, side="left")
    crossing = np.flatnonzero(first != last)
    owner = first.copy()
    whole = np.ones(len(ends))
    for t in crossing if rule != "first" else ():
        edges = np.clip(np.r_[starts[t], borders[first[t] : last[t]], ends[t]], starts[t], ends[t])
        sizes = np.diff(edges)
        if rule == "majority":
            owner[t] = first[t] + int(np.argmax(sizes))
        else:
            whole[t] = 0
            counts[first[t] : last[t] + 1] += sizes / sizes.sum()
    counts += np.bincount(owner, weights=whole, minlength=len(borders))
    return counts, len(crossing)


@lru_cache(maxsize=2)
def _encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(content, pattern)


def with_token_counts(df: DataFrame, fields: list[str], sectioned: str | None = None, vocabulary_path: str | None = None, rule: str = "majority", into: str = "tokens") -> tuple[DataFrame, str]:
    """Add a struct: n_tokens of the whole, crossing tokens, one double for each field, and ``sections``: the tokens
    of each line of the field ``sectioned``, line ends included.

    Null fields are like empty ones: their border still stands. Every row stays, other columns are untouched. All
    counts of fields, and of sections within their field, add up to n_tokens.
    """
    import public_tokenizers

    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    name = free_name(df, into)
    with open(vocabulary_path or default_vocabulary(), "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast((file.read(), public_tokenizers.PATTERN))
    labels = [f"f{k}" for k in range(len(fields))]
    kind = f"struct<n_tokens:long,crossing:long,{','.join(f'{label}:double' for label in labels)},sections:array<double>>"

    @F.pandas_udf(kind)
    def count(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(*shared.value)
        for batch in batches:
            out = []
            for row in zip(*batch):
                parts = [(value or "") + (BORDER if k < len(fields) - 1 else "") for k, value in enumerate(row)]
                borders, owners, end = [], [], 0
                for k, part in enumerate(parts):
                    lines = part.split("\n") if fields[k] == sectioned else [part]
                    for n, line in enumerate(lines):
                        end += len(line.encode()) + (n < len(lines) - 1)
                        borders.append(end)
                        owners.append(k)
                ends = encoder.ends("".join(parts))
                counts, crossing = attribute(ends, np.array(borders), rule)
                owners = np.array(owners)
                of_fields = np.bincount(owners, weights=counts, minlength=len(fields))
                sections = counts[owners == fields.index(sectioned)] if sectioned in fields else np.zeros(0)
                out.append((len(ends), crossing, *of_fields.tolist(), sections))
            yield pd.DataFrame(out, columns=["n_tokens", "crossing", *labels, "sections"])

    counted = df.withColumn(name, count(*[F.col(f"`{f}`").cast("string") for f in fields]))
    named = F.struct(F.col(name)["n_tokens"].alias("n_tokens"), F.col(name)["crossing"].alias("crossing"), *[F.col(name)[label].alias(f) for label, f in zip(labels, fields)], F.col(name)["sections"].alias("sections"))
    return counted.withColumn(name, named), name
