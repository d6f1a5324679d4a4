"""Quality classifier: supervised subword embeddings.

A text is the mean of the learned vectors of its features: words, pairs of neighbouring words, pairs in which the
second word only refers back to the first, and runs of three and four bytes, blanks included, each hashed to one of
``BUCKETS`` vectors. A softmax over two classes reads the mean. Vectors and softmax are trained by stochastic
gradient descent in one task, on a bounded, class-balanced sample of labelled rows; scoring reads every text whole.
Since both layers are linear, a scorer keeps one number per bucket: its vector's contribution to the log-odds.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_TO_SPACE, blocks, free_name, hashed_words, mixed, shingle_hashes

BITS = 16
BUCKETS = 1 << BITS
#: At most so many labelled rows of each class are fitted on.
TRAIN_ROWS = 1500
DIMENSION, EPOCHS, RATE, SEED = 8, 6, 0.3, 17
#: A fifth of the sample is kept from training to set the scale of the log-odds.
SCALE_SHARE = 5
BLOCK_CHARS = 1_000_000
PREDICT_AT = 0.7


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the features, and the text of each, kind after kind."""
    texts = [t.translate(BLANK_TO_SPACE) for t in texts]
    words, counts = hashed_words(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    codes = mixed(data.astype(np.uint64) + np.uint64(1))
    pairs, pair_counts = shingle_hashes(words, counts, 2)
    owner = np.repeat(np.arange(len(texts)), counts)
    back = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) if len(words) > 1 else np.zeros(0, np.int64)
    kinds = [(words, counts), (pairs, pair_counts), (np.zeros(len(back), np.uint64), np.bincount(owner[back], minlength=len(texts)))]
    kinds += [shingle_hashes(codes, lengths, width) for width in (3, 4)]
    buckets = [(mixed(values ^ np.uint64((kind + 1) << 56)) >> np.uint64(64 - BITS)).astype(np.int32) for kind, (values, _) in enumerate(kinds)]
    owners = [np.repeat(np.arange(len(texts), dtype=np.int32), n) for _, n in kinds]
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Vectors of the buckets, softmax weights and bias, and the scale and shift of the log-odds."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def log_odds(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the scaled log-odds of class 1, and what a text without features has."""
        toward = self.weights[:, 1] - self.weights[:, 0]
        return (self.scale * (self.vectors @ toward)).astype(np.float32), self.scale * float(self.bias[1] - self.bias[0]) + self.shift


def score(texts: list[str | None], share: np.ndarray, base: float) -> np.ndarray:
    """Probability of class 1 for each text; null and empty texts have no features and get the base."""
    encoded = [(t or "").encode() for t in texts]
    buckets, owner = features(encoded)
    total = np.bincount(owner, weights=share[buckets], minlength=len(texts))
    count = np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(base + total / np.maximum(count, 1), -30, 30)))


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """``texts``: of each text the distinct buckets and their shares; ``labels``: 0 or 1."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION))
    weights = rng.normal(0, 1, (DIMENSION, 2))
    model = Model(vectors, weights, np.zeros(2))
    rate = labels.mean() if len(labels) else 0.5
    if not 0 < rate < 1:
        rate = np.clip(rate, 0.01, 0.99)
        model.vectors[:] = 0
        model.bias[1] = np.log(rate / (1 - rate))
        return model
    order = rng.permutation(len(texts))
    kept, scaled = order[len(order) // SCALE_SHARE :], order[: len(order) // SCALE_SHARE]
    seen = np.full(BUCKETS, 1e-8)
    for epoch in range(EPOCHS):
        for k in rng.permutation(kept):
            at, share = texts[k]
            if not len(at):
                continue
            mean = share @ vectors[at]
            logits = mean @ weights + model.bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[k]] -= 1
            down = weights @ error
            seen[at] += (share * share) * (down @ down)
            step = RATE / (1 + epoch)
            vectors[at] -= (step * share / np.sqrt(seen[at]))[:, None] * down * 0.3
            weights -= step * 0.1 * np.outer(mean, error)
            model.bias -= step * 0.1 * error
    _set_scale(model, [texts[k] for k in scaled], labels[scaled])
    return model


def _set_scale(model: Model, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
    """Scale and shift of the log-odds that fit rows the vectors weren't trained on (a logistic fit with a prior)."""
    share, base = model.log_odds()
    raw = np.array([base + float(s @ share[at]) for at, s in texts])
    if len(set(labels.tolist())) < 2:
        return
    positive, negative = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    scale, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * raw + shift, -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - target) * raw).sum() + 0.01 * (scale - 1), (p - target).sum()])
        curve = np.array([[(w * raw * raw).sum() + 0.01, (w * raw).sum()], [(w * raw).sum(), w.sum()]])
        scale, shift = np.array([scale, shift]) - np.linalg.solve(curve, gradient)
    if scale > 0:
        model.scale, model.shift = float(scale), float(shift)


def is_held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label): at most TRAIN_ROWS of each class that are not held out, chosen by a hash of the key.

    Null keys and null labels teach nothing; of several labels of a key the least counts.
    """
    known = (
        labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
        .filter(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("key")))
        .groupBy("key").agg(F.min("label").alias("label"))
    )
    by_class = [known.filter(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(TRAIN_ROWS) for k in (0, 1)]
    return by_class[0].union(by_class[1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on the sample in one task; the model, a few MB whatever the corpus, comes to the driver."""
    chosen = sample(labels, key, label)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "key")

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for t in batch["text"]:
                at, n = np.unique(features([(t or "").encode()])[0], return_counts=True)
                found.append((at.astype("<i4").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()))
            yield pd.DataFrame({"key": batch["key"].astype(str), "label": batch["label"], "at": [a for a, _ in found], "share": [s for _, s in found]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"key": [], "label": [], "at": [], "share": []}), *batches]).sort_values(["key", "label", "at"], kind="stable")
        texts = [(np.frombuffer(a, "<i4"), np.frombuffer(s, "<f4").astype(float)) for a, s in zip(rows["at"], rows["share"])]
        model = fit(texts, rows["label"].to_numpy().astype(int))
        parts = [model.vectors.astype("<f4"), model.weights.astype("<f8"), np.array([*model.bias, model.scale, model.shift], "<f8")]
        yield pd.DataFrame({"vectors": [parts[0].tobytes()], "weights": [parts[1].tobytes()], "rest": [parts[2].tobytes()]})

    schema = "key string, label int, at binary, share binary"
    learnt = rows.mapInPandas(sparse, schema).repartition(1).mapInPandas(learn, "vectors binary, weights binary, rest binary").collect()[0]
    rest = np.frombuffer(learnt["rest"], "<f8")
    return Model(np.frombuffer(learnt["vectors"], "<f4").reshape(BUCKETS, DIMENSION), np.frombuffer(learnt["weights"], "<f8").reshape(DIMENSION, 2), rest[:2], float(rest[2]), float(rest[3]))


def with_score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> tuple[DataFrame, str]:
    """Add the probability of class 1. Every row stays; null and empty texts get the model's base rate."""
    name = free_name(df, into)
    shared = df.sparkSession.sparkContext.broadcast(model.log_odds())

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        share, base = shared.value
        for batch in batches:
            texts = batch.tolist()
            parts = [score(texts[a:b], share, base) for a, b in blocks((len(t or "") for t in texts), BLOCK_CHARS)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return df.withColumn(name, rate(F.col(f"`{text}`").cast("string"))), name
