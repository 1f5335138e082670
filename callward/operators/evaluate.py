"""Scoring of predictions against gold labels.

Cases are reduced to counts once; every metric is arithmetic over the counts.
Rounding is to 4 places, as reports show it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callward import vocab
from callward.operators.score import band

RULES = ("strict", "flagged", "risk")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def cases(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Join predictions and gold by call and add the three decision rules.

    predictions(call_id, classification, risk_score, ...); gold(call_id, gold_class, ...).
    """
    warn = vocab.ALERT_THRESHOLDS["WARNING"]
    return predictions.join(gold, "call_id").withColumns({
        "is_scam": F.col("gold_class") == "SCAM",
        "hit_strict": F.col("classification") == "SCAM",
        "hit_flagged": F.col("classification").isin("SCAM", "SUSPICIOUS"),
        "hit_risk": F.col("risk_score") >= warn,
    })


def decision_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Recall, false-positive rate, precision and F1 for each rule, accuracy and mean risk."""
    scam = F.col("is_scam")
    aggs = [
        F.count("*").alias("n"), F.count_if(scam).alias("n_scam"), F.count_if(~scam).alias("n_legitimate"),
        F.count_if(F.col("classification") == F.col("gold_class")).alias("_same"),
        F.sum(F.when(scam, F.col("risk_score"))).alias("_rs"),
        F.sum(F.when(~scam, F.col("risk_score"))).alias("_rl"),
    ]
    for r in RULES:
        aggs += [F.count_if(scam & F.col(f"hit_{r}")).alias(f"_tp_{r}"),
                 F.count_if(~scam & F.col(f"hit_{r}")).alias(f"_fp_{r}")]
    out = rows.groupBy(*by).agg(*aggs)
    cols = [F.col(b) for b in by] + [F.col("n"), F.col("n_scam"), F.col("n_legitimate")]
    for r in RULES:
        tp, fp = F.col(f"_tp_{r}"), F.col(f"_fp_{r}")
        p, q = _ratio(tp, tp + fp), _ratio(tp, F.col("n_scam"))
        cols += [
            F.round(q, 4).alias(f"recall_{r}"), F.round(_ratio(fp, F.col("n_legitimate")), 4).alias(f"fpr_{r}"),
            F.round(p, 4).alias(f"precision_{r}"), F.round(_ratio(2 * p * q, p + q), 4).alias(f"f1_{r}"),
        ]
    return out.select(
        *cols, F.round(_ratio(F.col("_same"), F.col("n")), 4).alias("accuracy"),
        F.round(_ratio(F.col("_rs"), F.col("n_scam")), 1).alias("mean_risk_scam"),
        F.round(_ratio(F.col("_rl"), F.col("n_legitimate")), 1).alias("mean_risk_legitimate"),
    )


def set_micro(rows: DataFrame, predicted: str, gold: str, *by: str) -> DataFrame:
    """Micro precision, recall, F1 and exact-set rate of set-valued labels."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    tp = F.size(F.array_intersect(p, g))
    fp, fn = F.size(F.array_except(p, g)), F.size(F.array_except(g, p))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"),
        F.count_if((fp == 0) & (fn == 0)).alias("exact"),
    )
    pr, rc = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select(
        *by, "n", "tp", "fp", "fn", F.round(pr, 4).alias("precision"), F.round(rc, 4).alias("recall"),
        F.round(_ratio(2 * pr * rc, pr + rc), 4).alias("f1"),
        F.round(_ratio(F.col("exact"), F.col("n")), 4).alias("exact_set_match"),
    )


def quality(rows: DataFrame, *by: str) -> DataFrame:
    """JSON validity and share of findings that are grounded."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("json_valid").cast("int")), 4).alias("json_validity"),
        F.round(F.sum("grounded") / F.greatest(F.sum("findings"), F.lit(1)), 4).alias("grounding_rate"),
    )


def by_slice(rows: DataFrame, slices: str = "slices") -> DataFrame:
    """A case counts in every slice it carries."""
    return decision_metrics(rows.withColumn("slice", F.explode(F.array_distinct(slices))), "slice")


def _histogram(rows: DataFrame) -> DataFrame:
    """At most 202 rows whatever the input size."""
    return rows.groupBy("risk_score", "is_scam").agg(F.count("*").alias("c"))


def threshold_sweep(rows: DataFrame, grid: tuple[int, ...] = tuple(range(10, 100, 5))) -> DataFrame:
    """Confusion counts and rates at every threshold, from the score histogram."""
    hist = _histogram(rows).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in grid])))
    flagged, scam = F.col("risk_score") >= F.col("threshold"), F.col("is_scam")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("c"))), F.lit(0)).cast("bigint")

    out = hist.groupBy("threshold").agg(
        total(scam & flagged).alias("tp"), total(~scam & flagged).alias("fp"),
        total(~scam & ~flagged).alias("tn"), total(scam & ~flagged).alias("fn"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return out.select(
        "threshold", "tp", "fp", "tn", "fn", F.round(r, 4).alias("recall"),
        F.round(_ratio(F.col("fp"), F.col("fp") + F.col("tn")), 4).alias("fpr"),
        F.round(p, 4).alias("precision"), F.round(_ratio(2 * p * r, p + r), 4).alias("f1"),
        r.alias("_r"), _ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("_f"),
    )


def best_threshold(sweep: DataFrame, max_fpr: float = 0.05) -> DataFrame:
    """Highest recall within the false-positive budget; the lowest threshold wins ties."""
    ok = sweep.filter(F.col("_f") <= max_fpr)
    return ok.orderBy(F.col("_r").desc(), "_f", "threshold").limit(1).drop("_r", "_f")


def band_distribution(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Calls per band and class, with empty cells."""
    counts = _histogram(rows).withColumn("level", band("risk_score")).groupBy("level").agg(
        F.sum(F.when(F.col("is_scam"), F.col("c"))).alias("scam"),
        F.sum(F.when(~F.col("is_scam"), F.col("c"))).alias("legitimate"))
    return bands.select("lo", "level").join(counts, "level", "left").fillna(0, ["scam", "legitimate"])


def failures(rows: DataFrame) -> DataFrame:
    """Missed scams and false alarms at the warning threshold."""
    return rows.filter(F.col("is_scam") != F.col("hit_risk"))


def generation_check(completions: DataFrame, n: int = 8) -> DataFrame:
    """Validity and agreement over the first n completions in order.

    completions(ord, valid, classification, gold_class)
    """
    first = completions.orderBy("ord").limit(n)
    return first.agg(
        F.count("*").alias("sampled"),
        F.round(F.coalesce(F.avg(F.col("valid").cast("int")), F.lit(0.0)), 3).alias("json_validity"),
        F.round(F.coalesce(F.avg(
            F.coalesce(F.col("valid") & (F.col("classification") == F.col("gold_class")), F.lit(False)).cast("int")
        ), F.lit(0.0)), 3).alias("classification_agreement"),
    )


def report_rows(overall: DataFrame) -> DataFrame:
    """One (metric, value) row per numeric column of a one-row metric table."""
    names = [c for c in overall.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return overall.select(F.inline(pairs))
