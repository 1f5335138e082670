"""Replay of calls as growing prefixes, and the state a live monitor keeps.

One update per new segment analyses the last 40 segments with the same batch
plan; peak, seen labels, stage progress and alerts are running values over the
updates of a call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callward import vocab
from callward.functions import text as T
from callward.operators.prefix import BLOCK, blocks_of, running
from callward.operators.score import band
from callward.operators.verdict import lookup


def updates(segments: DataFrame, step: int = 1, window: int = vocab.CONTEXT_WINDOW) -> DataFrame:
    """Rows of every prefix window: (call_id, upd, seq, ...); `upd` is the last segment heard.

    `segments` may hold several rows per segment, such as clauses.  Each takes part in at most `window` updates, so the output is bounded
    by the input whatever the length of a call.
    """
    n = segments.groupBy("call_id").agg((F.max("seq") + 1).alias("_n"))
    first = F.ceil((F.col("seq") + 1) / step)
    last = F.least(F.ceil((F.col("seq") + window) / step) + 1, F.ceil(F.col("_n") / step))
    out = segments.join(n, "call_id").withColumn("_j", F.explode(F.sequence(first, last)))
    out = out.withColumn("upd", F.least(F.col("_j") * step, F.col("_n")) - 1)
    return out.filter((F.col("upd") >= F.col("seq")) & (F.col("upd") - window < F.col("seq"))).drop("_n", "_j")


def as_calls(update_rows: DataFrame) -> DataFrame:
    """Treat every update as a call of its own, keyed by (call, update)."""
    return update_rows.withColumn("call_id", F.struct("call_id", "upd")).drop("upd")


def from_calls(df: DataFrame) -> DataFrame:
    return df.withColumns({"upd": F.col("call_id.upd"), "call_id": F.col("call_id.call_id")})


def _over_updates(df: DataFrame, values: dict, inclusive: bool, block: int = BLOCK) -> DataFrame:
    return running(df, ["call_id"], ["upd"], blocks_of(F.col("upd"), block), values, inclusive)


def hold_peak(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Peak score so far and its band: a past attack does not un-happen."""
    out = _over_updates(df, {"peak": ("max", F.col("risk_score"))}, True, block)
    return out.withColumn("peak_level", band("peak"))


def fresh_events(events: DataFrame) -> DataFrame:
    """Each distinct (category, second, quote) of a call once, at the update that first saw it."""
    key = ["call_id", "category", "sec", "quote"]
    rest = [c for c in events.columns if c not in ("call_id", "category", "sec", "upd")]
    return (
        events.withColumn("quote", T.quote_canon(F.col("evidence")))
        .groupBy(*key).agg(F.min(F.struct("upd", *rest)).alias("_f"))
        .select("call_id", "category", "sec", "_f.*")
    )


def first_seen_labels(df: DataFrame, labels: str) -> DataFrame:
    """Per call, each label once, in the order it first appeared."""
    seen = df.select("call_id", "upd", F.posexplode(labels).alias("p", "label")).groupBy("call_id", "label").agg(
        F.min(F.struct("upd", "p")).alias("at"))
    # at most one row per label of a closed vocabulary
    return seen.groupBy("call_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "label"))).alias("seen"))


def accumulate_labels(df: DataFrame, labels: str) -> DataFrame:
    """All labels seen up to each update, in first-seen order."""
    kept = F.filter("seen", lambda x: x["at"]["upd"] <= F.col("upd"))
    return df.join(first_seen_labels(df, labels), "call_id", "left").withColumn(
        f"all_{labels}",
        F.coalesce(F.transform(kept, lambda x: x["label"]), F.array().cast("array<string>")),
    ).drop("seen")


def stage_depth(stage: str = "stage") -> Column:
    return F.expr(lookup(stage, vocab.STAGE_DEPTH, "0"))


def deepest_stage(df: DataFrame, block: int = BLOCK) -> DataFrame:
    out = _over_updates(df.withColumn("_d", stage_depth()), {"_deep": ("max", F.col("_d"))}, True, block)
    return out.withColumn(
        "deepest_stage", F.expr(lookup("_deep", {d: s for s, d in vocab.STAGE_DEPTH.items()}))
    ).drop("_d", "_deep")


def stage_timeline(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """When each call entered a stage: repeats dropped, then regressions dropped."""
    entered = _over_updates(df, {"_before": ("last", F.col("stage"))}, False, block)
    entered = entered.filter(F.col("_before").isNull() | (F.col("_before") != F.col("stage"))).drop("_before")
    deep = _over_updates(
        entered.withColumn("depth", stage_depth()), {"_max": ("max", F.col("depth"))}, False, block)
    return deep.filter(F.col("_max").isNull() | (F.col("depth") >= F.col("_max"))).drop("_max")


def segments_added(df: DataFrame, block: int = BLOCK) -> DataFrame:
    out = _over_updates(df, {"_before": ("last", F.col("n_seen"))}, False, block)
    return out.withColumn("added", F.greatest(F.col("n_seen") - F.coalesce("_before", F.lit(0)), F.lit(0))).drop("_before")


def score_alert_rank(score: Column) -> Column:
    out = F.lit(0)
    for level, at in vocab.ALERT_THRESHOLDS.items():
        out = F.when(score >= at, vocab.ALERT_ORDER[level]).otherwise(out)
    return out


def critical_alerts(fresh: DataFrame, one_per_update: bool = False) -> DataFrame:
    """First alert per critical harmful category of a call.

    With `one_per_update` an update alerts on the first eligible event only.  A
    category can lose an update to each other category once, so its first nine
    candidate updates decide the outcome and a call folds at most 81 candidates.
    """
    hits = fresh.filter(F.col("category").isin(*vocab.HARMFUL) & (F.col("severity") == "CRITICAL"))
    ord_cols = ["sec", "category"]
    if not one_per_update:
        first = F.min(F.struct("upd", "sec", "evidence")).alias("_f")
        return hits.groupBy("call_id", "category").agg(first).select("call_id", "_f.upd", "category", "_f.sec")
    per_update = hits.groupBy("call_id", "category", "upd").agg(F.min("sec").alias("sec"))
    rank = Window.partitionBy("call_id", "category").orderBy("upd")
    few = per_update.withColumn("_rn", F.row_number().over(rank)).filter(F.col("_rn") <= len(vocab.HARMFUL))
    lists = few.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("upd", *ord_cols))).alias("c"))
    start = F.struct(
        F.array().cast("array<string>").alias("seen"), F.lit(-1).cast("bigint").alias("used"),
        F.array().cast("array<struct<upd:bigint,sec:bigint,category:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fires = ~F.array_contains(acc["seen"], x["category"]) & (acc["used"] != x["upd"])
        hit = F.struct(x["upd"].cast("bigint").alias("upd"), x["sec"].alias("sec"), x["category"].alias("category"))
        return F.struct(
            F.when(fires, F.array_append(acc["seen"], x["category"])).otherwise(acc["seen"]).alias("seen"),
            F.when(fires, x["upd"].cast("bigint")).otherwise(acc["used"]).alias("used"),
            F.when(fires, F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return lists.select("call_id", F.explode(F.aggregate("c", start, step)["out"]).alias("_o")).select(
        "call_id", "_o.upd", "_o.category", "_o.sec")


def alert_stream(df: DataFrame, fresh: DataFrame, one_per_update: bool = False, block: int = BLOCK) -> DataFrame:
    """Alerts of a replay: critical categories at once, score levels only when they escalate.

    df(call_id, upd, risk_score); fresh from `fresh_events`.  `score.guidance` has the advice that goes with a row.
    """
    crit = critical_alerts(fresh, one_per_update)
    marked = df.join(crit.select("call_id", "upd").distinct().withColumn("_crit", F.lit(3)), ["call_id", "upd"], "left")
    cand = score_alert_rank(F.col("risk_score"))
    marked = marked.withColumn("_rank", F.coalesce("_crit", cand))
    held = _over_updates(marked, {"_highest": ("max", F.col("_rank"))}, False, block)
    names = {v: k for k, v in vocab.ALERT_ORDER.items()}
    by_score = held.filter(
        F.col("_crit").isNull() & (F.col("_rank") > F.coalesce("_highest", F.lit(0)))
    ).select("call_id", "upd", F.expr(lookup("_rank", names)).alias("level"),
             F.lit("risk_score").alias("triggered_by"), "risk_score")
    by_event = crit.join(df.select("call_id", "upd", "risk_score"), ["call_id", "upd"]).select(
        "call_id", "upd", F.lit("CRITICAL").alias("level"), F.col("category").alias("triggered_by"), "risk_score")
    return by_event.unionByName(by_score)
