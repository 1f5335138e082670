"""Running values over an ordered group, computed in blocks.

A plain window puts one whole group into one task.  Here a group is cut into
blocks of its order key: block totals are combined on the map side, carried
forward over the few blocks of the group, and added to a window that never spans
more than one block.  Results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def blocks_of(order: Column, size: int = BLOCK) -> Column:
    return F.floor(order / size).cast("bigint")


def running(df: DataFrame, keys: list[str], order: list[str], block: Column,
            values: dict[str, tuple[str, Column]], inclusive: bool = False) -> DataFrame:
    """Add one running column per entry of `values`: name -> (op, input).

    Ops: sum, count, max, min, bit_or, last (previous row's value when exclusive),
    last_known (latest non-null value).  `order` must be unique within a group.
    """
    kept = df.columns
    ordering = F.struct(*order)
    df = df.select("*", block.alias("_blk"), *[
        (F.lit(1).cast("bigint") if op == "count" else value).alias(f"_v_{name}")
        for name, (op, value) in values.items()])

    def total(name: str, op: str) -> Column:
        v = F.col(f"_v_{name}")
        if op == "last":
            return F.max_by(v, ordering)
        if op == "last_known":
            return F.max_by(v, F.when(v.isNotNull(), ordering))
        return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "bit_or": F.bit_or}[op](v)

    across = Window.partitionBy(*keys).orderBy("_blk")
    past = across.rowsBetween(Window.unboundedPreceding, -1)

    def carried(name: str, op: str) -> Column:
        t = F.col(f"_t_{name}")
        if op == "last":
            return F.lag(t).over(across)
        if op == "last_known":
            return F.last(t, ignorenulls=True).over(past)
        return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "bit_or": F.bit_or}[op](t).over(past)

    totals = df.groupBy(*keys, "_blk").agg(*[total(n, op).alias(f"_t_{n}") for n, (op, _) in values.items()])
    carry = totals.select(*keys, "_blk", *[carried(n, op).alias(f"_c_{n}") for n, (op, _) in values.items()])
    here = Window.partitionBy(*keys, "_blk").orderBy(*order)
    frame = here.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0).cast("bigint")

    def combined(name: str, op: str) -> Column:
        v, c = F.col(f"_v_{name}"), F.col(f"_c_{name}")
        if op in ("sum", "count"):
            return F.coalesce(F.sum(v).over(frame), F.lit(0)) + F.coalesce(c, F.lit(0))
        if op == "max":
            return F.greatest(F.max(v).over(frame), c)
        if op == "min":
            return F.least(F.min(v).over(frame), c)
        if op == "bit_or":
            return F.coalesce(F.bit_or(v).over(frame), zero).bitwiseOR(F.coalesce(c, zero))
        if op == "last":
            return v if inclusive else F.when(F.row_number().over(here) == 1, c).otherwise(F.lag(v).over(here))
        return F.coalesce(F.last(v, ignorenulls=True).over(frame), c)

    return df.join(carry, [*keys, "_blk"]).select(
        *kept, *[combined(n, op).alias(n) for n, (op, _) in values.items()])
