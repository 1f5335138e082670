"""Sampled series: levels, activity regions, two-way splits, roles, resampling.

samples(series_id, i, x): one row per sample, `i` dense from 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callward.operators.cut import materialize
from callward.operators.prefix import BLOCK, blocks_of, running



def _db(mean_square: Column) -> Column:
    return 20.0 * F.log10(F.sqrt(mean_square) + 1e-9)


def frame_levels(samples: DataFrame, frame_len: int) -> DataFrame:
    """RMS level in dB per frame of `frame_len` samples; the last frame may be short."""
    return samples.groupBy("series_id", F.floor(F.col("i") / frame_len).cast("bigint").alias("frame")).agg(
        _db(F.avg(F.col("x") * F.col("x"))).alias("level"))


def thresholds(frames: DataFrame, margin_db: float = 8.0, floor_at: float = 0.15, peak_at: float = 0.95) -> DataFrame:
    """Noise floor and peak as order statistics of the levels, without interpolation.

    Equal levels are counted first and ranks are running counts over the distinct
    levels, so no series is sorted in one task.
    """
    counted = frames.groupBy("series_id", "level").agg(F.count("*").alias("c"))
    ranked = running(counted, ["series_id"], ["level"], F.floor(F.col("level") * 4).cast("bigint"),
                     {"_below": ("sum", F.col("c"))})
    n = frames.groupBy("series_id").agg(F.count("*").alias("n"))
    at = ranked.join(n, "series_id")

    def pick(share: float) -> Column:
        k = F.floor(F.col("n") * share)
        return F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("c")), F.col("level")))

    out = at.groupBy("series_id").agg(pick(floor_at).alias("noise_floor"), pick(peak_at).alias("peak"),
                                      F.max("n").alias("n"))
    return out.withColumns({
        "flat": F.col("peak") - F.col("noise_floor") < 6.0,
        "threshold": F.col("noise_floor") + margin_db,
    })


def active_regions(frames: DataFrame, limits: DataFrame, frame_seconds: float,
                   min_active: float = 0.25, max_gap: float = 0.30) -> DataFrame:
    """Stretches above the threshold; short gaps are bridged, short stretches dropped.

    A flat series is one region.  Regions give frame numbers and seconds; a stretch
    still open at the end of the series runs to its last frame.
    """
    gap_frames = math.ceil(max_gap / frame_seconds - 1e-9)
    voiced = frames.join(limits, "series_id").filter(~F.col("flat") & (F.col("level") > F.col("threshold"))).select(
        "series_id", "frame", "n")
    block = blocks_of(F.col("frame"), BLOCK)
    prev = running(voiced, ["series_id"], ["frame"], block, {"_prev": ("last", F.col("frame"))})
    fresh = prev.withColumn("_new", (
        F.col("_prev").isNull() | (F.col("frame") - F.col("_prev") - 1 >= gap_frames)).cast("bigint"))
    island = running(fresh, ["series_id"], ["frame"], block, {"island": ("sum", F.col("_new"))}, inclusive=True)
    spans = island.groupBy("series_id", "island").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_voiced"), F.max("n").alias("n"))
    open_end = F.col("n") - 1 - F.col("last_voiced") < gap_frames
    spans = spans.withColumn("last_frame", F.when(open_end, F.col("n") - 1).otherwise(F.col("last_voiced")))
    seconds = (F.col("last_frame") - F.col("first_frame") + 1) * frame_seconds
    kept = spans.filter(seconds >= min_active - 1e-9).select("series_id", "first_frame", "last_frame")
    whole = limits.filter("flat").select(
        "series_id", F.lit(0).cast("bigint").alias("first_frame"), (F.col("n") - 1).alias("last_frame"))
    return kept.unionByName(whole).withColumns({
        "start": F.col("first_frame") * frame_seconds,
        "end": (F.col("last_frame") + 1) * frame_seconds,
    })


def region_features(samples: DataFrame, regions: DataFrame, frame_len: int) -> DataFrame:
    """Level and zero-crossing rate (percent) per region.

    Samples meet regions through their frame number, one key per frame.
    """
    frames = regions.withColumn("frame", F.explode(F.sequence("first_frame", "last_frame"))).select(
        "series_id", "first_frame", "frame")
    s = samples.withColumn("frame", F.floor(F.col("i") / frame_len).cast("bigint")).join(frames, ["series_id", "frame"])
    nxt = s.select("series_id", "first_frame", (F.col("i") - 1).alias("i"), (F.col("x") >= 0).alias("_next"))
    pairs = s.join(nxt, ["series_id", "first_frame", "i"], "left")
    crossed = F.col("_next").isNotNull() & (F.col("_next") != (F.col("x") >= 0))
    return pairs.groupBy("series_id", "first_frame").agg(
        _db(F.avg(F.col("x") * F.col("x"))).alias("level"),
        (100.0 * F.count_if(crossed) / F.greatest(F.count("*") - 1, F.lit(1))).alias("crossings"))


def two_clusters(features: DataFrame, iterations: int = 25) -> DataFrame:
    """Split the regions of each series into two clusters, by joins and averages over the cluster.

    The features are computed once; every round reads them.
    """
    points = materialize(features.select("series_id", "first_frame", "level", "crossings"), "points")
    p = F.struct("level", "crossings")
    centres = points.groupBy("series_id").agg(F.min(p).alias("a"), F.max(p).alias("b"))

    def dist(c: str) -> Column:
        return (F.col("level") - F.col(f"{c}.level")) ** 2 + (F.col("crossings") - F.col(f"{c}.crossings")) ** 2

    def mean(k: int, old: str) -> Column:
        mine = F.col("cluster") == k
        avg = lambda x: F.coalesce(F.avg(F.when(mine, F.col(x))), F.max(F.col(f"{old}.{x}")))
        return F.struct(avg("level").alias("level"), avg("crossings").alias("crossings"))

    for _ in range(iterations - 1):
        labelled = points.join(centres, "series_id").withColumn("cluster", (dist("a") > dist("b")).cast("bigint"))
        moved = materialize(labelled.groupBy("series_id").agg(
            mean(0, "a").alias("na"), mean(1, "b").alias("nb"),
            F.first("a").alias("a"), F.first("b").alias("b")))
        still = moved.filter((F.col("na") != F.col("a")) | (F.col("nb") != F.col("b"))).limit(1).count() == 0
        centres = moved.select("series_id", F.col("na").alias("a"), F.col("nb").alias("b"))
        if still:
            break
    return points.join(centres, "series_id").select(
        "series_id", "first_frame", (dist("a") > dist("b")).cast("bigint").alias("cluster"))


def assign_roles(turns: DataFrame) -> DataFrame:
    """turns(series_id, pos, cluster, call_direction) -> role by order of first appearance.

    Two voices get roles, further ones stay UNKNOWN.
    """
    first = turns.groupBy("series_id", "cluster").agg(F.min("pos").alias("at"), F.max("call_direction").alias("d"))
    # only the two earliest clusters of a series matter
    opening = first.groupBy("series_id").agg(F.min("at").alias("one"))
    second = first.join(opening, "series_id").filter(F.col("at") > F.col("one")).groupBy("series_id").agg(
        F.min("at").alias("two"))
    ranked = first.join(opening, "series_id").join(second, "series_id", "left")
    inbound = F.col("d") == "inbound"
    role = (
        F.when(F.col("at") == F.col("one"), F.when(inbound, "VICTIM").otherwise("CALLER"))
        .when(F.col("at") == F.col("two"), F.when(inbound, "CALLER").otherwise("VICTIM"))
        .otherwise("UNKNOWN")
    )
    return ranked.select("series_id", "cluster", role.alias("speaker"))


def resample(samples: DataFrame, src_rate: int, dst_rate: int) -> DataFrame:
    """Linear resampling.  Each sample yields the output points that follow it."""
    n = samples.groupBy("series_id").agg((F.max("i") + 1).alias("n"))
    right = samples.select("series_id", (F.col("i") - 1).alias("i"), F.col("x").alias("_right"))
    pairs = samples.join(right, ["series_id", "i"], "left").join(n, "series_id")
    lo = F.floor((F.col("i") * dst_rate + (src_rate - 1)) / src_rate)
    hi = F.floor(((F.col("i") + 1) * dst_rate + (src_rate - 1)) / src_rate) - 1
    out_len = F.floor(F.col("n") * dst_rate / src_rate)
    j = F.explode(F.when(lo <= F.least(hi, out_len - 1), F.sequence(lo, F.least(hi, out_len - 1))))
    rows = pairs.select("series_id", "i", "x", F.coalesce("_right", "x").alias("_right"), j.alias("j"))
    frac = (F.col("j") * src_rate % dst_rate) / dst_rate
    return rows.select("series_id", F.col("j").alias("i"), (F.col("x") * (1 - frac) + F.col("_right") * frac).alias("x"))


def slice_seconds(samples: DataFrame, rate: int, start: float, end: float) -> DataFrame:
    return samples.filter((F.col("i") >= int(max(0.0, start) * rate)) & (F.col("i") < int(end * rate)))


def chunks(samples: DataFrame, window: int) -> DataFrame:
    """Fixed-size chunk number of every sample; the last chunk may be short."""
    return samples.withColumn("chunk", F.floor(F.col("i") / window).cast("bigint"))
