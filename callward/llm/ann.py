"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a vector by three rounds of random signs and a fast Hadamard transform and takes the
nearest signed axis; `width` such axes form a bucket.  A query probes the `probes` likeliest buckets
of each of `tables` tables.  Vectors are hashed within ranges of their norm (powers of NORM_STEP),
so that the largest inner products are found by direction within each range; unit vectors have one.

A bucket's members meet its queries in cells of at most about CELL x CELL rows, whatever the
bucket's size, and a cell yields at most k rows for each of its queries: no pairs are written.
Candidates are reranked by exact inner products of the original vectors in double precision, summed
in one order so that equal vectors tie; ties go to the smaller id.  Queries for which the tables find
fewer than k vectors are compared with all vectors, in cells as well, so that a small table is
searched in full.

Vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor do rows without an id.  Rows that repeat an id are one candidate by the best of
their scores, and never one for their own id.  An empty table gives an empty result.  One width
serves up to some millions of vectors with 64 components; beyond, choose 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callward.operators.cut import materialize

TABLES, PROBES, WIDTH = 8, 16, 1
CELL = 4096
NORM_STEP = 1.25
RESULT = "query_id long, vec_id long, score double"


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part; v has the components as doubles."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .where(F.col("id").isNotNull() & usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of the rows, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Rotation:
    """The pseudo-random rotations of one table."""

    def __init__(self, dim: int, table: int, width: int):
        self.n = 1 << max(0, (dim - 1).bit_length())
        rng = np.random.default_rng([11, table])
        self.signs = rng.choice(np.array([-1.0, 1.0]), (width, 3, self.n))

    def sides(self, x: np.ndarray) -> list[np.ndarray]:
        """For each axis of the bucket: the 2n signed projections."""
        full = np.zeros((len(x), self.n))
        full[:, :x.shape[1]] = x
        out = []
        for signs in self.signs:
            y = full
            for s in signs:
                y = _hadamard(y * s)
            out.append(np.concatenate((y, -y), 1))
        return out

    def codes(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The `probes` likeliest buckets of each row, by the sum of its projections."""
        code, value = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for side in self.sides(x):
            few = min(probes, side.shape[1])
            best = np.argsort(-side, axis=1, kind="stable")[:, :few]
            value = (value[:, :, None] + np.take_along_axis(side, best, 1)[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * (2 * self.n) + best[:, None, :]).reshape(len(x), -1)
            kept = np.argsort(-value, axis=1, kind="stable")[:, :probes]
            value, code = np.take_along_axis(value, kept, 1), np.take_along_axis(code, kept, 1)
        return code


def _hashed(rows: DataFrame, tables: int, width: int, probes: int, ranges: list[int] | None) -> DataFrame:
    """(key, id, v): each vector under its bucket of each table, or a query under all it probes.

    A query probes every norm range; there are at most a few hundred, as doubles go.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: list[Rotation] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.array(v) for v in batch.column("v").to_pylist()])
            norm = np.sqrt((x * x).sum(1))
            turned = turned or [Rotation(x.shape[1], t, width) for t in range(tables)]
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            own = np.round(np.log(norm) / math.log(NORM_STEP)).astype(np.int64)
            for t, rotation in enumerate(turned):
                codes = rotation.codes(x / norm[:, None], probes)
                for r in [None] if ranges is None else ranges:
                    place = (own[:, None] if r is None else np.full((len(x), 1), r)) * tables + t
                    key = (place * np.int64(2 * rotation.n) ** width + codes).reshape(-1)
                    at = pa.array(np.repeat(np.arange(len(x)), codes.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("id").take(at), raw.take(at)], names=["key", "id", "v"])

    return rows.select("id", "v").mapInArrow(run, "key long, id long, v binary")


def _meet(members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best members of each cell for each of its queries."""
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x = np.frombuffer(b"".join(left["v"])).reshape(len(left), -1)
        q = np.frombuffer(b"".join(right["v"])).reshape(len(right), -1)
        ids, asked = left["id"].to_numpy(), right["id"].to_numpy()
        out: list[tuple] = []
        for at in range(0, len(q), 256):
            scores = q[at:at + 256] @ x.T
            scores[ids[None, :] == asked[at:at + 256, None]] = -np.inf
            for row, own in enumerate(scores):
                least = np.partition(own, -k)[-k] if len(own) > k else -np.inf
                # the product may round otherwise than the sum below: keep what is near the last place
                near = np.flatnonzero((own >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else own > -np.inf))
                exact = (x[near] * q[at + row]).sum(1)
                first = np.lexsort((ids[near], -exact))[:k]
                out.append((np.full(len(first), asked[at + row]), ids[near][first], exact[first]))
        a, b, c = (np.concatenate(y) for y in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    sizes = members.groupBy("key").agg(F.count("*").alias("n")).join(
        queries.groupBy("key").agg(F.count("*").alias("m")), "key").select(
        "key", F.ceil(F.col("n") / CELL).alias("down"), F.ceil(F.col("m") / CELL).alias("across"))
    slot = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    left = members.join(sizes, "key").select(
        "key", "id", "v", slot(F.col("down"), 1).alias("x"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("y"))
    right = queries.join(sizes, "key").select(
        "key", "id", "v", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("x"), slot(F.col("across"), 2).alias("y"))
    cell = ["key", "x", "y"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(lambda a, b: best(a, b), RESULT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exhaustive(members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The exact k nearest, every query against every vector in cells."""
    def plain(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [np.array(v, float).tobytes() for v in batch.column("v").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(batch.num_rows, np.int64)), batch.column("id"), pa.array(raw, pa.binary())], names=["key", "id", "v"])

        return rows.select("id", "v").mapInArrow(run, "key long, id long, v binary")

    return _ranked(_meet(plain(members), plain(queries), k), k)


def nearest(members: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, probes: int = PROBES,
            width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, from tables of (id, v)."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    ranges = sorted(int(r[0]) for r in members.select(F.round(F.log(norm) / math.log(NORM_STEP)).alias("r")).distinct().collect())
    index = _hashed(members, tables, width, 1, None)
    asked = _hashed(queries, tables, width, probes, ranges)
    found = materialize(_ranked(_meet(index, asked, k), k), "neighbours")
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = queries.join(enough, "id", "left_anti")
    rest = exhaustive(members, short, k)
    done = found.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi")
    return done.unionByName(rest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
