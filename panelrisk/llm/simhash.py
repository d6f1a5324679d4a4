"""Near-duplicate documents by SimHash fingerprints, linked through BK-trees.

Fingerprints are made once and written. Equal ones collapse; the distinct ones are cut into five blocks of bits, and
two of them that differ in at most three bits agree in at least two blocks, so each goes to ten shards, one for each
pair of blocks. A shard holds a BK-tree (children keyed by their integer Hamming distance to the parent) and is
searched along the edges within the radius only. Shard trees reach their probes through the shuffle instead of a
broadcast: together they hold every fingerprint, which must not pass through the driver. A shard of more than
``SHARD`` fingerprints is cut into several trees, and its probes visit each of them. A shard returns a spanning
forest of its links, never its pairs; components grow from those by alternating large-star and small-star rounds.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, written

RADIUS = 3
WORDS = 3
SHARD = 8192
#: Shingles counted at a time, pairs of probe and node visited at a time, rows of shards in memory at a time.
CHUNK, VISITS, ROWS = 16_384, 2_000_000, 60_000

#: Five blocks of 13, 13, 13, 13 and 12 bits.
_EDGES = (0, 13, 26, 39, 52, 64)
_BLOCKS = [((1 << b) - (1 << a)) for a, b in zip(_EDGES, _EDGES[1:])]
#: For each pair of blocks the mask of their bits, as the signed number Spark takes.
MASKS = [int(np.uint64(_BLOCKS[i] | _BLOCKS[j]).astype(np.int64)) for i, j in combinations(range(5), 2)]


def fingerprint(text: str | None) -> int:
    """64 bits, each set if set in over half the shingles' hashes; no words: zero."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, only the six blanks part words
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < WORDS else list(map(b" ".join, zip(*(words[k:] for k in range(WORDS)))))
    total = np.zeros(64, np.int64)
    for a in range(0, len(shingles), CHUNK):
        part = shingles[a : a + CHUNK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in part), dtype="<u8", count=len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(shingles), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint") -> tuple[DataFrame, str]:
    """Add the fingerprint as a signed 64-bit column; null texts are like empty ones, every row stays."""
    name = free_name(df, into)

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).astype(np.int64))

    return df.withColumn(name, prints(F.col(f"`{text}`").cast("string"))), name


class Forest:
    """BK-trees of many shards, built level by level: the first value of a group becomes its node, the others move
    to the child at their distance from it."""

    def __init__(self, shard: np.ndarray, values: np.ndarray) -> None:
        """``shard``: ascending small numbers; ``values``: distinct within a shard."""
        self.values = values
        n = len(values)
        keys, kids = [], []
        members, group = np.arange(n), shard.astype(np.int64)
        self.roots = np.full(int(shard.max()) + 1 if n else 0, -1, np.int64)
        level = 0
        while len(members):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            nodes = members[first]
            if level:
                keys.append(group[first])
                kids.append(nodes)
            else:
                self.roots[group[first]] = nodes
            node = np.repeat(nodes, np.diff(np.r_[first, len(members)]))
            rest = np.ones(len(members), bool)
            rest[first] = False
            members, node = members[rest], node[rest]
            group = node * 65 + np.bitwise_count(values[members] ^ values[node]).astype(np.int64)
            by = np.argsort(group, kind="stable")
            members, group = members[by], group[by]
            level += 1
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        by = np.argsort(keys, kind="stable")
        self.edges = keys[by]  # parent * 65 + distance
        self.children = (np.concatenate(kids) if kids else np.zeros(0, np.int64))[by]

    def search(self, shard: np.ndarray, probes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Probe numbers and node numbers within the radius, a bounded block at a time."""
        start = self.roots[shard]
        who = np.flatnonzero(start >= 0)
        stack = [(who, start[who])]
        while stack:
            who, node = stack.pop()
            if len(who) > VISITS:
                half = len(who) // 2
                stack += [(who[:half], node[:half]), (who[half:], node[half:])]
                continue
            if not len(who):
                continue
            apart = np.bitwise_count(probes[who] ^ self.values[node]).astype(np.int64)
            near = apart <= radius
            if near.any():
                yield who[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(apart + radius, 64), side="right")
            count = high - low
            total = int(count.sum())
            if total:
                offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                stack.append((np.repeat(who, count), self.children[np.repeat(low, count) + offset]))


def _least_labels(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least number that each of n things reaches through the links."""
    label = np.arange(n)
    for a, b in links:
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def forest_links(shard: np.ndarray, values: np.ndarray, planted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (value, least value) of the links that the shards' trees of ``planted`` rows show."""
    by = np.lexsort((values, shard))  # sorted, so that the least label is the least value of a shard
    shard, values, planted = shard[by], values[by], planted[by]
    tree = np.flatnonzero(planted)
    if not len(tree) or len(values) < 2:
        return values[:0], values[:0]
    shuffled = tree[np.lexsort((values[tree] * np.uint64(0x9E3779B97F4A7C15), shard[tree]))]  # no sorted chains of nodes
    forest = Forest(shard[shuffled], values[shuffled])
    if len(forest.roots) <= shard.max():
        forest.roots = np.r_[forest.roots, np.full(int(shard.max()) + 1 - len(forest.roots), -1)]
    label = _least_labels(len(values), ((who, shuffled[node]) for who, node in forest.search(shard, values, radius)))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return values[moved], values[label[moved]]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``prints`` (column fp) whose components are those of all links
    of ``radius`` bits or fewer; at most 3, the bits for which the shards are complete."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the shards find links of at most {RADIUS} bits")
    cut = F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(MASKS)]))
    shards = prints.select("fp", cut.alias("s")).select("fp", "s.pair", "s.bits")
    large = (
        shards.groupBy("pair", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD)
        .select("pair", "bits", F.ceil(F.col("n") / SHARD).cast("int").alias("trees"))
    )
    trees = F.coalesce("trees", F.lit(1))
    probes = (
        shards.join(large, ["pair", "bits"], "left")
        .select("pair", "bits", "fp", F.pmod(F.xxhash64("fp"), trees).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), trees - 1)).alias("tree"))
        .select("pair", "bits", "tree", "fp", (F.col("own") == F.col("tree")).alias("planted"))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def found(part: pd.DataFrame) -> pd.DataFrame:
            new = (part[["pair", "bits", "tree"]] != part[["pair", "bits", "tree"]].shift()).any(axis=1)
            shard = new.to_numpy().cumsum() - 1
            sizes = np.bincount(shard) if len(shard) else np.zeros(0, int)
            some = sizes[shard] > 1 if len(shard) else np.zeros(0, bool)
            part, shard = part[some], shard[some]
            shard = np.unique(shard, return_inverse=True)[1]
            a, b = forest_links(shard, part.fp.to_numpy().astype(np.uint64), part.planted.to_numpy().astype(bool), radius)
            return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= ROWS:
                part = pd.concat(held, ignore_index=True)
                last = part.iloc[-1]
                open_ = ((part.pair == last.pair) & (part.bits == last.bits) & (part.tree == last.tree)).to_numpy()
                if not open_.all():
                    yield found(part[~open_])
                held, rows = [part[open_]], int(open_.sum())
        if held:
            yield found(pd.concat(held, ignore_index=True))

    order = ["pair", "bits", "tree"]
    return probes.repartition(*order).sortWithinPartitions(*order).mapInPandas(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node it reaches. Written tables cut the
    lineage of each round; rounds go on until a round changes nothing."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")

    def tell(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    state = tell(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        seen, before, edges = state, edges, after
        state = tell(edges)
        forget(before)
        if state == seen:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id, n_linked): one row for each row of ``df``.

    component_id is the least key reachable over links of ``radius`` bits or fewer, the row itself included;
    n_linked is how many rows share the component. Texts without words (null, empty, blank) have fingerprint zero
    and link like any other. Repeated keys keep their rows. A row with a null key links others like any row, but
    is never a component's least key; a component of null keys only has a null id.
    """
    prints, name = with_fingerprint(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", "fp")
    prints = written(prints.select("key", name), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    found = components(links(distinct.select("fp"), radius))
    linked = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_linked"))
    named = linked.select("fp", "root").join(whole, "root").select("fp", "component_id", "n_linked")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id", "n_linked")
