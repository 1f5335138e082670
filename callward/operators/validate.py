"""Contract checks: label cleaning, defaults, ranges, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callward import vocab
from callward.functions import text as T


def clean_labels(labels: Column, allowed: tuple[str, ...]) -> Column:
    """Upper-case, underscores for spaces, known labels only, first of each."""
    norm = F.transform(labels, lambda x: F.replace(F.upper(T.strip(x)), F.lit(" "), F.lit("_")))
    known = F.filter(norm, lambda x: x.isin(*allowed))
    return F.coalesce(F.array_distinct(known), F.array().cast("array<string>"))


def clean_label(label: Column, allowed: tuple[str, ...]) -> Column:
    """The same for one text: a list of one label, or none."""
    return clean_labels(F.when(label.isNotNull(), F.array(label)), allowed)


def clean_stage(stage: Column) -> Column:
    name = F.upper(T.strip(F.coalesce(stage, F.lit(""))))
    return F.when(name.isin(*vocab.STAGE_DEPTH), name).otherwise("UNKNOWN")


def quarantine_categories(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known categories (normalised) and the rows whose category is unknown."""
    name = F.upper(T.strip(F.coalesce("category", F.lit(""))))
    df = events.withColumn("category", name)
    known = name.isin("", *vocab.CATEGORIES)
    return df.filter(F.col("category").isin("", *vocab.CATEGORIES)), events.filter(~known)


def segment_violations(segments: DataFrame) -> DataFrame:
    """Rows outside the allowed ranges or vocabularies, with the reason."""
    c = F.col
    bad = (
        F.when(c("seq") < 0, "index below 0").when(c("start") < 0, "start below 0").when(c("end") < 0, "end below 0")
        .when((c("confidence") < 0) | (c("confidence") > 1), "confidence out of range")
        .when(~c("speaker").isin(*vocab.SPEAKERS), "unknown speaker")
    )
    return segments.withColumn("violation", bad).filter("violation is not null")


def repair_segments(segments: DataFrame) -> DataFrame:
    return segments.withColumns({
        "end": F.greatest("end", "start"),
        "text_original": F.when(F.coalesce("text_original", F.lit("")) == "", F.col("text")).otherwise(F.col("text_original")),
    })


def duplicate_keys(segments: DataFrame) -> DataFrame:
    return segments.groupBy("call_id", "seq").agg(F.count("*").alias("n")).filter("n > 1")
