"""Runs of repeated words, found as maximal pairs.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no
neighbouring word extends with period q.  Runs of at least `min_length` words and `EXPONENT` periods
are found.

Two occurrences of a stretch of words that differ in the word before and the word behind them are a
maximal pair.  If they are p words apart and the stretch has 3 p words or more, both together are
exactly a run of period p, with 4 periods at least, and every such run shows up this way; nothing is
extended afterwards.  The maximal pairs come from the tree of LCP intervals of a text's suffix
array, walked bottom up: an interval whose suffixes share n words pairs the suffixes of different
children that lie at most n / 3 apart and follow different words.  Suffixes so close together whose
left words agree form one class: a suffix meets at most one that follows another word, the first of
the run, so that a whole class is passed over in one step.  A period that is a multiple of another
one gives the same stretch and the smaller one stays.

The suffix array is built by doubling, for many texts at once, and only for suffixes that can take
part: those that share their first h words with another one at most 2 h / 3 words away, for some h
of 3, 6, 12 and so on.  Sorting goes on only where suffixes still agree.

Texts are handled in slices of some megabytes, a text as a whole; memory is bounded by a slice or the
longest text.  Null or empty texts have no words and no runs.  Repeated rows are handled each for
itself.  An empty table gives an empty result.  No other column than the two named is read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callward.llm.common import ranges, slices, split_words

EXPONENT = 4
EXPONENT_STEP = EXPONENT - 1  # a maximal pair p apart shares at least that many times p words
MIN_LENGTH = 6
START = 3  # words that the first sort compares
RESULT = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _first_order(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions by their first START words, whether each differs from the one before)."""
    key = w.copy()
    for k in range(1, START):
        if int(key.max()) >= (1 << 62) // (int(w.max()) + 1):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * (int(w.max()) + 1) + np.concatenate((w[k:], np.zeros(k, np.int64)))
    order = np.argsort(key)
    key = key[order]
    return order, np.concatenate(([True], key[1:] != key[:-1]))


def _starts(new: np.ndarray) -> np.ndarray:
    """For each row the place of the last one marked as new."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class Suffixes:
    """Sorted suffixes of many texts that may begin or continue a run, with their common prefixes.

    `w`: the words as numbers, texts divided by numbers that occur once; `text`: each place's text.
    """

    def __init__(self, w: np.ndarray, text: np.ndarray):
        self.w, self.text = w, text
        self.ranks: list[np.ndarray] = []
        order, new = _first_order(w)
        rank = np.empty(len(w), np.int64)
        rank[order] = _starts(new)
        alone = new & np.concatenate((new[1:], [True]))
        places = np.sort(order[~alone])
        ties = text[places]  # equal words in two texts are told apart here
        marked = np.zeros(len(w), bool)
        h = START
        while len(places):
            by = np.lexsort((places, ties, rank[places]))
            places, ties = places[by], ties[by]
            own = rank[places]
            group = np.concatenate(([True], own[1:] != own[:-1]))
            new = group | np.concatenate(([True], ties[1:] != ties[:-1]))
            rank[places] = own + _starts(new) - _starts(group)
            self.ranks.append(rank.astype(np.int32 if len(w) < 1 << 31 else np.int64))
            near = ~new[1:] & (np.diff(places) <= (2 * h - 1) // EXPONENT_STEP)
            marked[places[1:][near]] = True
            marked[places[:-1][near]] = True
            places = np.sort(places[~(new & np.concatenate((new[1:], [True])))])
            ties = rank[places + h]
            h *= 2
        taking = np.flatnonzero(marked)
        self.places = taking[np.lexsort((rank[taking], text[taking]))]

    def common(self) -> np.ndarray:
        """Words that each suffix shares with the one before it; 0 where the text differs."""
        if not len(self.places):
            return np.zeros(0, np.int64)
        a, b = self.places[:-1], self.places[1:]
        same = self.text[a] == self.text[b]
        a, b = a[same], b[same]
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            n += (START << k) * (self.ranks[k][a + n] == self.ranks[k][b + n])
        for _ in range(START - 1):
            n += self.w[a + n] == self.w[b + n]
        out = np.zeros(len(self.places), np.int64)
        out[1:][same] = n
        return out


class IntervalTree:
    """One bottom-up walk over the LCP intervals of a cluster of suffixes."""

    def __init__(self, left: dict[int, int], found: dict[tuple[int, int], int], least: int):
        self.left, self.found, self.least = left, found, least

    def _pair(self, i: int, j: int, shared: int) -> None:
        """Keep a maximal pair as (begin, end) with its smallest period."""
        p = j - i
        if p + shared >= self.least:
            stretch = (i, j + shared)
            self.found[stretch] = min(p, self.found.get(stretch, p))

    def _union(self, a: list[int], b: list[int], shared: int) -> list[int]:
        """Places of two children of an interval, in order; pairs between them are kept."""
        if len(a) < len(b):
            a, b = b, a
        left, reach = self.left, shared // EXPONENT_STEP
        for x in b:
            own, k = left[x], bisect_left(a, x - reach)
            if k < len(a) and a[k] < x and left[a[k]] != own:
                self._pair(a[k], x, shared)
            k = bisect_right(a, x)
            if k < len(a) and a[k] <= x + reach and left[a[k]] != own:
                while k < len(a) and a[k] <= x + reach:
                    self._pair(x, a[k], shared)
                    k += 1
        if len(b) * 8 < len(a):
            for x in b:
                insort(a, x)
        else:
            a += b
            a.sort()
        return a

    def walk(self, places: list[int], common: list[int]) -> None:
        """`common`: the words each suffix shares with the one before; the first entry isn't read."""
        open_: list[tuple[int, list[int]]] = []
        for k in range(1, len(places) + 1):
            shared = common[k] if k < len(places) else -1
            node = [places[k - 1]]
            while open_ and open_[-1][0] > shared:
                depth, rest = open_.pop()
                node = self._union(rest, node, depth)
            if open_ and open_[-1][0] == shared:
                open_[-1] = (shared, self._union(open_[-1][1], node, shared))
            else:
                open_.append((shared, node))


def find(codes: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows of (text, start, length, period), in order, of texts whose codes lie between `ends`."""
    sizes = np.diff(ends)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) + text + 1
    w = np.zeros(len(codes) + len(sizes) + 1, np.int64)
    words = int(codes.max()) + 1 if len(codes) else 0
    stops = np.concatenate(([0], ends[1:] + np.arange(1, len(sizes) + 1)))
    w[stops] = words + np.arange(len(stops))
    w[place] = codes
    of = np.zeros(len(w), np.int64)
    of[place], of[stops[1:]] = text, np.arange(len(sizes))
    suffixes = Suffixes(w, of)
    places, common = suffixes.places, suffixes.common()
    least = min_length - max(1, min_length // EXPONENT)  # what the two occurrences share at least
    cuts = np.flatnonzero(common < least)
    found: dict[tuple[int, int], int] = {}
    tree = IntervalTree(dict(zip(places.tolist(), w[places - 1].tolist(), strict=True)), found, min_length)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(places)], strict=False):
        if b - a > 1:
            tree.walk(places[a:b].tolist(), common[a:b].tolist())
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.array([(i, e - i, p) for (i, e), p in found.items()], np.int64)
    own = of[rows[:, 0]]
    rows = np.column_stack((own, rows[:, 0] - stops[own] - 1, rows[:, 1:]))
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run repeats."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        kept[start + period:start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed, the text without what its runs repeat.

    `collapsed` has the words of the text with one space between them; a word goes if any run holds
    it behind that run's first period.  `docs` needs doc_id and text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes, ends, _ = split_words(part.column("text"))
                found = find(codes.astype(np.int64), ends, min_length)
                edges = np.searchsorted(found[:, 0], np.arange(part.num_rows + 1))
                collapsed = []
                for k, raw in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    words = (raw or b"").split()
                    own = found[edges[k]:edges[k + 1], 1:]
                    collapsed.append(_collapse(words, own) if len(own) else b" ".join(words))
                each = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
