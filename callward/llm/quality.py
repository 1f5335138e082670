"""Quality classifier: word, word-pair and character n-gram vectors averaged over the document.

Words keep case and punctuation.  Texts are split at ASCII white space and scored whole, where they
lie; nothing but the bounded sample of labelled rows reaches the driver, and nothing but one number
per bucket reaches the tasks.  A pair of equal neighbours is one feature whatever the word.

Null and empty texts get the score of the bias alone.  Without labelled rows, or with one label
only, every document gets the share of label 1 among them (0.5 without any).  Repeated rows are
scored each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from callward.llm.common import ranges, slices, split_words
from callward.llm.subwords import Model, Shape, Trainer, feature_lists, pairs, sample, sigmoid, word_weights

SAMPLE_ROWS = 6000
SAMPLE_TEXT_BYTES = 64_000
SHAPE = Shape()
EPOCHS, BATCH, UNITS, RATE = 12, 64, 64, 0.3
SLICE = 2 << 20  # bytes of text that are scored at once


def train(rows: list[tuple[str, int, float]], shape: Shape = SHAPE, epochs: int = EPOCHS, seed: int = 7, units: int = UNITS) -> Model:
    """SGD over `units` random units (words and pairs) of each document in each epoch."""
    labels = np.array([y for _, y, _ in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        return Model(shape, np.zeros(shape.buckets, np.float32), math.log(share / (1 - share)))
    weights = np.array([w for *_, w in rows])
    codes, offsets, distinct = split_words(pa.array([t for t, *_ in rows]))
    at, many, whole = feature_lists(distinct, shape)
    del distinct
    begin = np.cumsum(many, dtype=np.int64) - many
    place, pair = pairs(whole[codes] if len(whole) else whole, offsets, shape.bits)
    pair_at = np.full(len(codes), -1)
    pair_at[place] = pair
    trainer, n = Trainer(shape, seed), len(rows)
    steps, done = epochs * -(-n // BATCH), 0
    for _ in range(epochs):
        turn = trainer.rng.permutation(n)
        for k in range(0, n, BATCH):
            docs = turn[k:k + BATCH]
            docs = docs[offsets[docs + 1] > offsets[docs]]
            sizes = np.minimum(offsets[docs + 1] - offsets[docs], units)
            row = np.repeat(np.arange(len(docs)), sizes)
            span = np.repeat(offsets[docs + 1] - offsets[docs], sizes)
            unit = np.repeat(offsets[docs], sizes) + (trainer.rng.random(len(row)) * span).astype(np.int64)
            own = many[codes[unit]]
            feature = at[np.repeat(begin[codes[unit]], own) + ranges(own)]
            with_pair = pair_at[unit] >= 0
            total = sizes + np.bincount(row, with_pair, len(docs))
            trainer.step(
                np.concatenate((np.repeat(row, own), row[with_pair])),
                np.concatenate((feature, pair_at[unit][with_pair])),
                np.concatenate((np.repeat(1 / (own * total[row]), own), (1 / total[row])[with_pair])),
                labels[docs], weights[docs], RATE * (1 - done / steps))
            done += 1
    return trainer.model()


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    codes, offsets, distinct = split_words(texts)
    value, whole = word_weights(distinct, model)
    place, pair = pairs(whole[codes] if len(distinct) else whole, offsets, model.shape.bits)
    units = np.concatenate(([0], np.cumsum(value[codes] if len(distinct) else value)))
    total = units[offsets[1:]] - units[offsets[:-1]]
    by_pair = np.zeros(len(codes) + 1)
    by_pair[place + 1] = model.weight[pair]
    run = np.cumsum(by_pair)
    total += run[offsets[1:]] - run[offsets[:-1]]
    n = np.diff(offsets)
    return sigmoid(model.bias + total / np.maximum(2 * n - 1, 1))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS,
        text_bytes: int = SAMPLE_TEXT_BYTES, units: int = UNITS) -> Model:
    return train(sample(docs, labels, label, learn, rows, text_bytes), units=units)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores(part.column("text"), model))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(pa.array(scores(part.column("text"), model) >= threshold))

    return docs.mapInArrow(run, docs.schema)

