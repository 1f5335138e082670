"""Hard negatives: rows of another label that score just below an anchor's positives.

Components are scaled by `scale` and floored; a score is the integer inner product.  An anchor's
positives are its best rows of the same label, and its negatives for a positive the best rows of
other labels whose score lies within two shares of the positive's.

Rows are coded (`coded`).  A vector is turned by random signs and a Hadamard transform and kept as a
cascade of one-bit codes: the signs of the turned vector, then those of what they leave over, and so on,
each level with half the weight of the one before.  With them go the alignment of code and vector (the
best factor for the sum of the codes) and the length of the rest.  Members have MEMBER_BITS levels, anchors
ANCHOR_BITS.

Anchors meet members in cells of at most CELL x CELL rows.  In a cell the score of a pair is first
estimated from the codes alone, by counting the bits in which they differ.  By Cauchy-Schwarz the estimate
is off by the rests' lengths at most, |rest of member| * |anchor| + |code of member| * |rest of anchor|,
so that each pair has an interval that holds its score.  Pairs whose interval can't reach the last
place, or lies outside a window, are left out; the others are scored in integers.  Results don't
depend on the codes.  To bring the last place close at once, the pairs of highest estimate are scored
first.  A cell gives at most k rows for each anchor and positive; nothing is written for pairs.

A row takes part if it has an id, a label and a vector without null or non-finite components; zero and
empty vectors do.  Rows of another length than the anchor's are not compared with it.  An id stands for one
row: of several, the one with the smallest label, then vector.  Rows with components of 2^26 or more in
size after scaling take no part, as their scores could leave 64 bits.  An empty table gives an empty result.
Columns other than the three named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callward.operators.cut import materialize

CELL = 16384
CHUNK = 8           # anchors of a cell that are handled at once
FIRST = 64          # pairs of an anchor that are scored to begin with
MEMBER_BITS, ANCHOR_BITS = 4, 6
# The step between levels that suits a normal distribution best, by number of bits.
STEPS = {1: 1.596, 2: 0.9957, 3: 0.586, 4: 0.3352, 5: 0.1881, 6: 0.1041, 7: 0.0569, 8: 0.0308}
LARGEST = 1 << 26
ROUNDING = 1e-4     # share of the lengths' product by which single precision may be off
CODED = "id long, label long, dim int, v binary, codes binary, sizes binary"


def usable(v: Column, below: float) -> Column:
    """Neither null nor with null or non-finite components, nor any of `below` or more in size."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < below)), F.lit(False))


def rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
         scale: float = 256.0) -> DataFrame:
    """(id, label, v) of the rows that take part, one per id; v has the scaled integers."""
    taken = table.select(
        F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and label is not null").where(usable(F.col("v"), LARGEST / scale))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    return taken.select("id", "label", whole.alias("v")).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")) \
        .select("id", "r.label", "r.v")


# --- codes -------------------------------------------------------------------------------


def turned(x: np.ndarray) -> np.ndarray:
    """The rows after three rounds of random signs and a Hadamard transform, on a power of two of at least 64 axes."""
    n = 1 << max(6, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n), np.float64)
    y[:, :x.shape[1]] = x
    rng = np.random.default_rng([29, n])
    for _ in range(3):
        y *= rng.choice(np.array([-1.0, 1.0]), n)
        h = 1
        while h < n:
            y = y.reshape(len(x), n // (2 * h), 2, h)
            y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
            h *= 2
        y /= math.sqrt(n)
    return y


def cascade(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sizes): `bits` levels of codes of each row, and its alignment, length, and those of code and rest."""
    y = turned(x)
    weight = np.sqrt((y ** 2).mean(1)) * STEPS[bits] * 2.0 ** (bits - 2)
    rest, code = y.copy(), np.zeros_like(y)
    levels = []
    for k in range(bits):
        signs = rest >= 0
        levels.append(np.packbits(signs, axis=1, bitorder="little").view(np.uint64))
        side = np.where(signs, 1.0, -1.0)
        rest -= side * (weight * 0.5 ** k)[:, None]
        code += side * 2.0 ** (bits - 1 - k)
    aligned = (y * code).sum(1) / (code ** 2).sum(1)
    length = lambda v: np.sqrt((v ** 2).sum(1))
    sizes = (aligned, length(x.astype(np.float64)), aligned * length(code), length(y - code * aligned[:, None]))
    return np.stack(levels, 1), np.column_stack(sizes).astype(np.float32)


def coded(members: DataFrame, bits: int) -> DataFrame:
    """(id, label, dim, v, codes, sizes): integers and codes in bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            dims = np.diff(lists.offsets.to_numpy())
            flat, begins = lists.flatten().to_numpy(), np.cumsum(dims) - dims
            out: list[list] = [[None] * batch.num_rows for _ in range(3)]
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = flat[begins[own][:, None] + np.arange(dim)].astype("<i4")
                for column, value in zip(out, (x, *cascade(x, bits)), strict=True):
                    for k, row in zip(own.tolist(), value, strict=True):
                        column[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(dims, pa.int32()), *(pa.array(c, pa.binary()) for c in out)],
                names=["id", "label", "dim", "v", "codes", "sizes"])

    return members.select("id", "label", "v").mapInArrow(run, CODED)


@dataclass(frozen=True)
class Block:
    """Rows of a cell as arrays."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray        # (row, component)
    codes: np.ndarray    # (row, level, word)
    aligned: np.ndarray
    length: np.ndarray
    own: np.ndarray      # length of what the codes say
    left: np.ndarray     # length of what they leave over

    @classmethod
    def of(cls, rows: pd.DataFrame, bits: int) -> Block:
        many = len(rows)
        return cls(rows["id"].to_numpy(), rows["label"].to_numpy(),
                   np.frombuffer(b"".join(rows["v"]), "<i4").reshape(many, -1).astype(np.int64),
                   np.frombuffer(b"".join(rows["codes"]), np.uint64).reshape(many, bits, -1),
                   *np.frombuffer(b"".join(rows["sizes"]), np.float32).reshape(many, -1).T)

    def intervals(self, members: Block, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, how far the score may be off) of some anchors of this block with all members."""
        codes = self.codes[part]
        differ = np.zeros((len(codes), len(members.ids)), np.int64 if codes.shape[2] > 1 << 12 else np.int32)
        levels, own = members.codes.shape[1], codes.shape[1]
        for j in range(levels):
            for k in range(own):
                for word in range(codes.shape[2]):
                    bits = np.bitwise_count(codes[:, k, word, None] ^ members.codes[None, :, j, word])
                    differ += np.left_shift(bits, levels - 1 - j + own - 1 - k, dtype=differ.dtype)
        agree = 64.0 * codes.shape[2] * ((1 << levels) - 1) * ((1 << own) - 1) - 2.0 * differ.astype(np.float32)
        estimate = agree * self.aligned[part, None] * members.aligned[None, :]
        off = self.length[part, None] * members.left[None, :] + self.left[part, None] * members.own[None, :]
        off += ROUNDING * self.length[part, None] * members.length[None, :] + 1e-3
        return estimate, off

    def scores(self, members: Block, anchor: int, chosen: np.ndarray) -> np.ndarray:
        return members.v[chosen] @ self.v[anchor]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _top(estimate: np.ndarray, n: int) -> np.ndarray:
    return np.argpartition(-estimate, n)[:n] if len(estimate) > n else np.arange(len(estimate))


# --- cells -------------------------------------------------------------------------------


def _cells(members: DataFrame, anchors: DataFrame, by: list[str], best: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
           schema: str, cell: int) -> DataFrame:
    """`best` of every cell: members and anchors that agree in `by`, dealt to cells of at most about cell x cell."""
    anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # both may come from one table
    sizes = members.groupBy(*by).agg(F.count("*").alias("n")).join(anchors.groupBy(*by).agg(F.count("*").alias("m")), by).select(
        *by, F.ceil(F.col("n") / cell).alias("down"), F.ceil(F.col("m") / cell).alias("across"))
    slot = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = members.join(sizes, by).withColumn("x", slot(F.col("down"), 1)).withColumn("y", each(F.col("across"))).drop("down", "across")
    right = anchors.join(sizes, by).withColumn("y", slot(F.col("across"), 2)).withColumn("x", each(F.col("down"))).drop("down", "across")
    key = [*by, "x", "y"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: best(a, b), schema)


def positives(members: DataFrame, anchors: DataFrame, k: int = 5, cell: int = CELL) -> DataFrame:
    """(anchor_id, positive_id, positive_score, place): each anchor's k best other rows of its label, place from 1."""
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            rows, asked = Block.of(left, MEMBER_BITS), Block.of(right, ANCHOR_BITS)
            for at in range(0, len(asked.ids), CHUNK):
                part = slice(at, min(at + CHUNK, len(asked.ids)))
                estimate, off = asked.intervals(rows, part)
                for a, (guess, width) in enumerate(zip(estimate, off, strict=True), at):
                    others = rows.ids != asked.ids[a]
                    first = _top(np.where(others, guess, -np.inf), FIRST)
                    first = first[others[first]]
                    scores = asked.scores(rows, a, first)
                    least = np.partition(scores, -k)[-k] if len(scores) >= k else -math.inf
                    others[first] = False
                    rest = np.flatnonzero(others & (guess + width >= least))
                    ids = rows.ids[np.concatenate((first, rest))]
                    scores = np.concatenate((scores, asked.scores(rows, a, rest)))
                    out += [(int(asked.ids[a]), int(ids[m]), int(scores[m])) for m in _best(ids, scores, k)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"], dtype="int64")

    found = _cells(members, anchors, ["dim", "label"], best, "anchor_id long, positive_id long, positive_score long", cell)
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def window(positive: int, low: int, high: int, base: int) -> tuple[int, int]:
    """The scores s with low * positive <= base * s <= high * positive."""
    return -(-low * positive // base), high * positive // base


def negatives(members: DataFrame, anchors: DataFrame, found: DataFrame, k: int = 3, low: int = 50, high: int = 95, base: int = 100,
              cell: int = CELL) -> DataFrame:
    """For each anchor and positive of `found`, the first k rows of other labels within the window of scores."""
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, int]] = []
        if len(left) and len(right):
            rows, asked = Block.of(left, MEMBER_BITS), Block.of(right, ANCHOR_BITS)
            wanted = [[(int(p["positive_id"]), int(p["positive_score"])) for p in own] for own in right["found"]]
            for at in range(0, len(asked.ids), CHUNK):
                part = slice(at, min(at + CHUNK, len(asked.ids)))
                estimate, off = asked.intervals(rows, part)
                for a, (guess, width) in enumerate(zip(estimate, off, strict=True), at):
                    other = rows.labels != asked.labels[a]
                    value, known = np.zeros(len(other), np.int64), np.zeros(len(other), bool)

                    def scored(chosen: np.ndarray) -> np.ndarray:
                        new = chosen[~known[chosen]]
                        value[new], known[new] = asked.scores(rows, a, new), True
                        return value[chosen]

                    for positive, score in wanted[a]:
                        bottom, top = window(score, low, high, base)
                        if bottom > top:
                            continue
                        can = np.flatnonzero(other & (guess + width >= bottom) & (guess - width <= top))
                        # what the estimate puts into the window is scored first, highest first
                        first = can[_top(np.where(guess[can] <= top, guess[can], -math.inf), FIRST)]
                        scores = scored(first)
                        inside = scores[(scores >= bottom) & (scores <= top)]
                        least = np.partition(inside, -k)[-k] if len(inside) >= k else bottom
                        can = can[guess[can] + width[can] >= least]
                        scores = scored(can)
                        good = np.flatnonzero((scores >= bottom) & (scores <= top))
                        out += [(int(asked.ids[a]), positive, score, int(rows.ids[can[m]]), int(scores[m]))
                                for m in good[_best(rows.ids[can[good]], scores[good], k)].tolist()]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"], dtype="int64")

    own = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found"))  # k at most
    asked = anchors.join(own.withColumnRenamed("anchor_id", "id"), "id")
    best_rows = _cells(members, asked, ["dim"], best,
                       "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", cell)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return best_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(members: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
         base: int = 100, cell: int = CELL) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `members`: (id, label, v) as `rows` gives them; `anchors`: which of them are anchors, by id.
    """
    table = materialize(members, "scaled")
    every, asked = coded(table, MEMBER_BITS), coded(table.where(anchors), ANCHOR_BITS)
    found = materialize(positives(every, asked, n_positives, cell), "positives")
    return negatives(every, asked, found, n_negatives, low, high, base, cell).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
