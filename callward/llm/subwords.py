"""Hashed subword vectors averaged into a linear softmax, trained in numpy.

Shared by the toxicity and the quality model.  A word's vector is the mean of the vectors of its
own hash and of its character n-grams with boundary marks; unseen spellings share n-grams with seen
ones.  Vectors and softmax weights are trained together by stochastic gradient descent on a bounded
sample of labelled rows.  As everything up to the softmax is linear, scoring needs one number per
bucket: the vector's share in the difference of the two logits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callward.llm.common import ranges

P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Shape:
    bits: int = 17
    dim: int = 8
    shortest: int = 3
    longest: int = 5

    @property
    def buckets(self) -> int:
        return 1 << self.bits


@dataclass(frozen=True)
class Model:
    """Logit share of each bucket, and the bias; `known` tells the buckets that count, all where it is None."""

    shape: Shape
    weight: np.ndarray
    bias: float
    known: np.ndarray | None = None


def _bucket(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) * P
    h ^= h >> np.uint64(31)
    return ((h * Q) >> np.uint64(64 - bits)).astype(np.int64)


def features(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of each feature, its bucket, hash of each word)."""
    if not words:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(sizes.max()), P))))
    whole = np.add.reduceat(points * powers[ranges(sizes)], starts)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(starts + sizes, sizes) - np.arange(len(points))
    of, at = [np.arange(len(words))], [_bucket(whole, 1, shape.bits)]
    h = points.copy()
    for n in range(2, min(shape.longest, len(points)) + 1):
        h[:len(points) - n + 1] = h[:len(points) - n + 1] * Q + points[n - 1:]
        if n >= shape.shortest:
            ok = np.flatnonzero(room >= n)
            of.append(owner[ok])
            at.append(_bucket(h[ok], n, shape.bits))
    return np.concatenate(of), np.concatenate(at), whole


def feature_lists(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all words one after the other, number of each word's, hash of each word), made part by part."""
    ats, many, hashes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for k in range(0, len(words), 10_000):
        part = words[k:k + 10_000]
        of, at, whole = features(part, shape)
        ats.append(at[np.argsort(of, kind="stable")].astype(np.int32))
        many.append(np.bincount(of, minlength=len(part)).astype(np.int32))
        hashes.append(whole)
    return np.concatenate(ats), np.concatenate(many), np.concatenate(hashes)


def pairs(hashes: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the second word, bucket) of neighbouring words within a text; equal neighbours share one bucket."""
    if len(hashes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.ones(len(hashes), bool)
    inside[offsets[:-1][offsets[:-1] < len(hashes)]] = False
    place = np.flatnonzero(inside)
    a, b = hashes[place - 1], hashes[place]
    at = _bucket(a * Q + b, 2, bits)
    at[a == b] = _bucket(np.zeros(1, np.uint64), 3, bits)[0]
    return place, at


def word_weights(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(logit share of each word, its hash)."""
    values, hashes = [np.zeros(0)], [np.zeros(0, np.uint64)]
    for k in range(0, len(words), 16_384):
        part = words[k:k + 16_384]
        of, at, whole = features(part, model.shape)
        if model.known is not None:
            counts = model.known[at]
            of, at = of[counts], at[counts]
        values.append(np.bincount(of, model.weight[at], len(part)) / np.maximum(np.bincount(of, minlength=len(part)), 1))
        hashes.append(whole)
    return np.concatenate(values), np.concatenate(hashes)


# --- the labelled sample -----------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, text_bytes: int) -> list[tuple[str, int, float]]:
    """(text, label, weight) of at most `rows` labelled rows, half of them of each label where there are as many.

    Rows are chosen by a hash of the id; the weight restores the share of each label.  `learn` says
    of a doc_id whether its label may be seen.  Texts longer than `text_bytes` aren't learned from,
    so that the sample has at most rows * text_bytes bytes; they are scored like any other.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = docs.where(learn & F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes)).select("doc_id") \
        .join(own, "doc_id").distinct()
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    if not counts:
        return []
    want = {k: min(v, max(rows // 2, rows - sum(c for j, c in counts.items() if j != k))) for k, v in counts.items()}
    chosen = [r for k, n in sorted(want.items()) for r in
              ids.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    label_of = {r["doc_id"]: r["label"] for r in chosen}
    # at most `rows` ids, so that the broadcast is bounded as well
    few = docs.sparkSession.createDataFrame([(i,) for i in label_of], "doc_id long")
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").where(F.octet_length("text") <= text_bytes)
    found = sorted({(r["doc_id"], r["text"]) for r in texts.collect()})
    total = sum(counts.values())
    return [(t, label_of[i], counts[label_of[i]] / want[label_of[i]] * sum(want.values()) / total) for i, t in found]


# --- training ------------------------------------------------------------------------------


class Trainer:
    """Bucket vectors, softmax weights and bias; rows of a batch come as (row, bucket, share)."""

    def __init__(self, shape: Shape, seed: int = 7):
        self.shape, self.rng = shape, np.random.default_rng(seed)
        self.vectors = self.rng.uniform(-0.5, 0.5, (shape.buckets, shape.dim)) / shape.dim
        self.out = np.zeros((shape.dim, 2))
        self.bias = np.zeros(2)
        self.seen = np.full(shape.buckets, 1e-8)
        self.seen_out, self.seen_bias = 1e-8, 1e-8

    def step(self, row: np.ndarray, bucket: np.ndarray, share: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float) -> None:
        n, dim = len(label), self.shape.dim
        drawn = self.vectors[bucket] * share[:, None]
        mean = np.stack([np.bincount(row, drawn[:, d], n) for d in range(dim)], 1)
        logits = mean @ self.out + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), label] -= 1
        p *= weight[:, None] / n
        back = p @ self.out.T
        rows, where = np.unique(bucket, return_inverse=True)
        slope = np.stack([np.bincount(where, back[row, d] * share, len(rows)) for d in range(dim)], 1)
        out, bias = mean.T @ p, p.sum(0)
        self.seen[rows] += (slope ** 2).mean(1)
        self.seen_out += (out ** 2).mean()
        self.seen_bias += (bias ** 2).mean()
        self.vectors[rows] -= rate * slope / np.sqrt(self.seen[rows])[:, None]
        self.out -= rate * out / np.sqrt(self.seen_out)
        self.bias -= rate * bias / np.sqrt(self.seen_bias)

    def model(self) -> Model:
        apart = self.out[:, 1] - self.out[:, 0]
        return Model(self.shape, (self.vectors @ apart).astype(np.float32), float(self.bias[1] - self.bias[0]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
