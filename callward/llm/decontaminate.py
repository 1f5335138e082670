"""Benchmark decontamination with sparse suffix arrays over shards of the training text.

A shard is a slice of one Arrow batch of documents.  Its suffix array holds the word positions at which
some benchmark window may begin; other suffixes can't match and are left out.  Every window of
every benchmark item is looked up by binary search, and the suffixes found give the places.
Documents never move: there is no shuffle, and each document is judged by the task that reads it.

The benchmark reaches the tasks in blocks of at most `block_bytes` of text, each broadcast by
itself, so that neither the driver nor a task holds more than one block at a time.

Words are runs of digits, letters and characters beyond ASCII, after lower-casing A-Z.
Nulls and texts without words: no words, not contaminated.  Items of fewer than `window` words
are one window; items without words never occur.  Items with a null id count for hits, not for
`n_items`.  Repeated rows are judged row by row; repeated items count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callward.llm.common import ranges, slices

WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))
BLOCK_BYTES = 32 << 20
FILTER_BITS = 22
PREFIX = 3


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def _slots(ids: np.ndarray, depth: int) -> np.ndarray:
    """Filter slot of the first `depth` words from each position."""
    n = len(ids) - depth + 1
    key = np.zeros(max(n, 0), np.uint64)
    for j in range(depth):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[j:j + n].astype(np.uint64)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Benchmark:
    """The windows of one block of items, sorted by length and words."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        groups: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                groups.setdefault(size, {}).setdefault(tuple(ids[at:at + size]), set()).add(item)
        self.sizes = sorted(groups)
        self.depth = min([PREFIX, *self.sizes])
        self.known = np.zeros(1 << FILTER_BITS, bool)
        self.queries = {}
        for size, found in groups.items():
            rows = np.array(list(found), np.uint32).reshape(len(found), size)
            self.known[_slots(rows[:, :self.depth].reshape(-1), self.depth)[::self.depth]] = True
            owners = [sorted(x for x in own if x is not None) for own in found.values()]
            self.queries[size] = (
                self._key(rows, 0), self._key(rows, 255),
                np.array([len(x) for x in owners]), np.array([x for own in owners for x in own], np.int64))

    def _key(self, rows: np.ndarray, fill: int) -> np.ndarray:
        """Words as big-endian bytes, filled to the window: byte order is word order."""
        full = np.full((len(rows), self.window * 4), fill, np.uint8)
        full[:, :rows.shape[1] * 4] = np.ascontiguousarray(rows.astype(">u4")).view(np.uint8).reshape(len(rows), rows.shape[1] * 4)
        return full.reshape(-1).view(f"S{self.window * 4}")

    def search(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[tuple]]:
        """Words of each text, and the windows found: (place in the shard, window size, query, its owners).

        Texts follow each other with one empty place behind each.
        """
        get, end = self.vocabulary.get, np.zeros(1, np.uint32)
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = words(text)
            sizes[k] = len(own)
            parts += [np.fromiter(map(get, own, repeat(0)), np.uint32, len(own)), end]
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        ids = np.concatenate([*parts, np.zeros(self.window, np.uint32)])
        slots = _slots(ids, self.depth)[:starts[-1]]
        places = np.flatnonzero(self.known[slots] & (ids[:len(slots)] > 0))
        suffixes = self._key(np.lib.stride_tricks.sliding_window_view(ids, self.window)[places], 0)
        order = np.argsort(suffixes, kind="stable")
        places, suffixes = places[order], suffixes[order]
        found = []
        for size in self.sizes:
            low, high, owners, owner = self.queries[size]
            first = np.searchsorted(suffixes, low, "left")
            many = np.searchsorted(suffixes, high, "right") - first
            hit = np.flatnonzero(many > 0)
            if len(hit):
                many = many[hit]
                query = np.repeat(hit, many)
                place = places[np.repeat(first[hit], many) + ranges(many)]
                at = np.concatenate(([0], np.cumsum(owners)))
                found.append((place, size, query, owners, owner, at))
        return sizes, found


def judge(texts: list[bytes | None], blocks: Iterable[Benchmark]) -> dict[str, list]:
    """Hits of one shard: words, hit words, items, and the longest verbatim run with its place."""
    owned: list[np.ndarray] = []
    turn = starts = sizes = None
    for block in blocks:
        sizes, found = block.search(texts)
        if turn is None:
            starts = np.concatenate(([0], np.cumsum(sizes + 1)))
            turn = np.zeros(starts[-1] + 1, np.int32)
        for place, size, query, owners, owner, at in found:
            np.add.at(turn, place, 1)
            np.add.at(turn, place + size, -1)
            many = owners[query]
            item = owner[np.repeat(at[query], many) + ranges(many)]
            doc = np.searchsorted(starts, np.repeat(place, many), "right") - 1
            owned.append(np.unique(np.stack([doc, item], 1), axis=0))
    covered = np.cumsum(turn[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(covered)))
    n_hit = total[starts[1:]] - total[starts[:-1]]
    items: list[list[str]] = [[] for _ in texts]
    if owned:
        for doc, item in np.unique(np.concatenate(owned), axis=0).tolist():
            items[doc].append(str(item))
    longest, where = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    for begin, end in zip(edges[::2], edges[1::2], strict=True):
        doc = int(np.searchsorted(starts, begin, "right") - 1)
        if end - begin > longest[doc]:
            longest[doc], where[doc] = end - begin, begin - starts[doc]
    return {"n_words": sizes, "n_hit": n_hit, "n_items": np.array([len(x) for x in items], np.int64),
            "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items],
            "longest_hit": longest, "longest_at": where}


_OPEN: dict[tuple[int, int], Benchmark] = {}


def _opened(block: Broadcast, window: int) -> Benchmark:
    """The block's index; a worker keeps the last one."""
    key = (block._jbroadcast.id() if block._jbroadcast else id(block), window)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Benchmark(block.value, window)
    return _OPEN[key]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[Broadcast]:
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    out = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        out.append(spark.sparkContext.broadcast(sorted(
            {(r[0], bytes(r[1])) for r in part.toLocalIterator()}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))))
    return out


def _scan(blocks: list[Broadcast], window: int, share: tuple[int, int]):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = judge(batch.column("__text").to_pylist(), (_opened(b, window) for b in blocks))
                found["contaminated"] = (found["n_hit"] > 0) & (share[1] * found["n_hit"] >= share[0] * found["n_words"])
                yield batch, found
    return judged


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: tuple[int, int] = (1, 20),
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, words inside benchmark windows, items met, verdict, longest verbatim run.

    Contaminated: some hit, and hit words at least `share` (a fraction) of the words.
    """
    judged = _scan(_blocks(benchmark, block_bytes), window, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in judged(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **found})

    return docs.select("doc_id", F.col("text").cast("binary").alias("__text")).mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
             "longest_hit long, longest_at long, contaminated boolean")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: tuple[int, int] = (1, 20),
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    judged = _scan(_blocks(benchmark, block_bytes), window, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in judged(batches):
            yield batch.drop_columns(["__text"]).filter(pa.array(~found["contaminated"]))

    return docs.withColumn("__text", F.col("text").cast("binary")).mapInArrow(run, docs.schema)
