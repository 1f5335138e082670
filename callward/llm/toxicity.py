"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

The bag is a window of words, by default of one: a few insults in a long text would vanish in its
mean, and a wider bag lets the model learn the clean words around them by heart.  A document's
score is that of its worst window, and in training each document stands for the window that the
current model finds worst, after some epochs over random words.  Words are lower-cased and lose
the punctuation around them, and a word that repeats at once counts once; unseen misspellings share
character n-grams with seen words.  Buckets that occur in few of the documents learned from are left
out, in training and in scoring: they tell documents apart, not words.  The model is the mean of
several that begin at random.

Null and empty texts get the score of the bias alone.  Without labelled rows, or with one label
only, every document gets the share of label 1 among them (0.5 without any).  Repeated rows are
scored each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from callward.llm.common import ranges, slices, split_words
from callward.llm.subwords import Model, Shape, Trainer, feature_lists, sample, sigmoid, word_weights

SAMPLE_ROWS = 6000
SAMPLE_TEXT_BYTES = 64_000
SHAPE = Shape(bits=19, longest=7)
WINDOW, STRIDE = 1, 1
FIRST, DRAWN, EPOCHS, BATCH, RATE = 5, 2, 15, 64, 0.3
MODELS = 3
RARE = 150  # a bucket counts if one document in so many has it, or LEAST documents
LEAST = 20
AROUND = ".,;:!?\"'()[]{}<>|*%$#&_-/\\"


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    codes, offsets, distinct = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    kept = np.ones(len(codes), bool)
    kept[1:] = codes[1:] != codes[:-1]
    kept[offsets[:-1][offsets[:-1] < len(codes)]] = True
    return codes[kept], np.concatenate(([0], np.cumsum(kept)))[offsets], [w.strip(AROUND) for w in distinct]


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, number of windows per text); texts up to a window long are one window."""
    n = np.diff(offsets)
    many = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    begin = np.repeat(offsets[:-1], many) + ranges(many) * STRIDE
    end = np.minimum(begin + WINDOW, np.repeat(offsets[1:], many))
    return np.maximum(end - WINDOW, np.repeat(offsets[:-1], many)), end, many


def _means(value: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0)
    base, until = int(begin.min()), int(end.max())
    run = np.concatenate(([0], np.cumsum(value[codes[base:until]])))
    return (run[end - base] - run[begin - base]) / (end - begin)


def _worst(value: np.ndarray, codes: np.ndarray, offsets: np.ndarray, together: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the worst window of each document, some documents at a time; an empty one has none."""
    found = [np.zeros((0, 2), np.int64)]
    for k in range(0, len(offsets) - 1, together):
        begin, end, many = windows(offsets[k:k + together + 1])
        mean, last = _means(value, codes, begin, end), np.cumsum(many)
        best = [b - n + int(mean[b - n:b].argmax()) if n else -1 for b, n in zip(last.tolist(), many.tolist(), strict=True)]
        found.append(np.array([(begin[i], end[i]) if i >= 0 else (0, 0) for i in best], np.int64))
    spans = np.concatenate(found)
    return spans[:, 0], spans[:, 1]


def _common(at: np.ndarray, own: np.ndarray, codes: np.ndarray, offsets: np.ndarray, least: int, buckets: int) -> np.ndarray:
    """Whether at least so many documents have a bucket, for every bucket."""
    first = np.cumsum(own, dtype=np.int64) - own
    documents = np.zeros(buckets, np.int64)
    for a, b in zip(offsets, offsets[1:], strict=False):
        words = np.unique(codes[a:b])
        many = own[words]
        documents[np.unique(at[np.repeat(first[words], many) + ranges(many)])] += 1
    return documents >= least


def train(rows: list[tuple[str, int, float]], shape: Shape = SHAPE, epochs: int = EPOCHS, models: int = MODELS, first_epochs: int = FIRST,
          drawn: int = DRAWN) -> Model:
    """`drawn` random words of each document are learned from in each of the first epochs, then its worst window."""
    labels = np.array([y for _, y, _ in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        return Model(shape, np.zeros(shape.buckets, np.float32), math.log(share / (1 - share)))
    weights = np.array([w for *_, w in rows])
    codes, offsets, distinct = _split(pa.array([t for t, *_ in rows]))
    at, own, _ = feature_lists(distinct, shape)
    known = _common(at, own, codes, offsets, max(1, min(LEAST, len(rows) // RARE)), shape.buckets)
    del distinct
    kept = known[at]
    before = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))
    ends = np.cumsum(own, dtype=np.int64)
    at, own = at[kept], before[ends] - before[ends - own]
    del kept, before, ends
    found = [_train(at, own, codes, offsets, labels, weights, shape, epochs, first_epochs, drawn, seed) for seed in range(models)]
    weight = np.mean([m.weight for m in found], axis=0)
    return Model(shape, np.where(known, weight, 0).astype(np.float32), float(np.mean([m.bias for m in found])), known)


def _train(at: np.ndarray, own: np.ndarray, codes: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray, shape: Shape,
           epochs: int, first_epochs: int, drawn: int, seed: int) -> Model:
    """One model; the buckets of word k are own[k] entries of `at`."""
    first = np.cumsum(own, dtype=np.int64) - own
    full = np.flatnonzero(np.diff(offsets) > 0)
    trainer = Trainer(shape, seed)
    steps, done = epochs * -(-len(full) // BATCH), 0
    for epoch in range(epochs):
        if epoch >= first_epochs:
            total = np.concatenate(([0], np.cumsum(trainer.model().weight[at])))
            value = (total[first + own] - total[first]) / np.maximum(own, 1)
            begin, end = _worst(value, codes, offsets)
        turn = trainer.rng.permutation(full)
        for k in range(0, len(turn), BATCH):
            docs = turn[k:k + BATCH]
            if epoch < first_epochs:
                sizes = np.minimum(offsets[docs + 1] - offsets[docs], drawn)
                span = np.repeat(offsets[docs + 1] - offsets[docs], sizes)
                unit = np.repeat(offsets[docs], sizes) + (trainer.rng.random(sizes.sum()) * span).astype(np.int64)
            else:
                sizes = end[docs] - begin[docs]
                unit = np.repeat(begin[docs], sizes) + ranges(sizes)
            row = np.repeat(np.arange(len(docs)), sizes)
            word = codes[unit]
            each = own[word]
            trainer.step(np.repeat(row, each), at[np.repeat(first[word], each) + ranges(each)],
                         np.repeat(1 / (np.maximum(each, 1) * sizes[row]), each), labels[docs], weights[docs], RATE * (1 - done / steps))
            done += 1
    return trainer.model()


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    codes, offsets, distinct = _split(texts)
    value, _ = word_weights(distinct, model)
    begin, end, many = windows(offsets)
    worst = np.zeros(len(many))
    full = np.flatnonzero(many > 0)
    if len(full):
        worst[full] = np.maximum.reduceat(_means(value, codes, begin, end), (np.cumsum(many) - many)[full])
    return sigmoid(model.bias + worst)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS,
        text_bytes: int = SAMPLE_TEXT_BYTES, epochs: int = EPOCHS, first_epochs: int = FIRST, drawn: int = DRAWN) -> Model:
    return train(sample(docs, labels, label, learn, rows, text_bytes), epochs=epochs, first_epochs=first_epochs, drawn=drawn)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores(part.column("text"), model))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
