"""Masking of credentials in free text.

A number is masked by what stands around it.  The text is cut at the digit runs
and folded from left to right with the last 28 characters carried along, so the
whole rule stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callward import vocab
from callward.functions.text import SPACE, let

DIGIT_RUN = rf"(?<!\p{{Nd}})(\p{{Nd}}[\p{{Nd}}{SPACE}-]{{1,22}}\p{{Nd}})(?!\p{{Nd}})"
CUE = "(?iu)" + "|".join(vocab.CREDENTIAL_CUES)
CURRENCY = f"(?iu)^[{SPACE}]*(?:" + "|".join(vocab.CURRENCY_WORDS) + ")"
LOOK_BACK, LOOK_AHEAD = 28, 14


def mask_sensitive(text: Column) -> Column:
    """struct(text, labels): masked text and one label per masked number, in order."""
    cut = F.struct(
        F.split(text, DIGIT_RUN, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(DIGIT_RUN), F.lit(1)).alias("runs"))
    return let(cut, _fold)


def _fold(cut: Column) -> Column:
    pieces = cut["pieces"]
    steps = F.transform(
        cut["runs"],
        lambda run, i: F.struct(
            run.alias("run"),
            F.get(pieces, i).alias("before"),
            F.substring(F.get(pieces, i + 1), 1, LOOK_AHEAD).alias("after"),
            F.length(F.regexp_replace(run, r"[^\p{Nd}]", "")).alias("digits"),
        ),
    )
    start = F.struct(
        F.lit("").alias("text"), F.lit("").alias("tail"),
        F.array().cast("array<string>").alias("labels"),
    )

    def step(acc: Column, s: Column) -> Column:
        seen = F.concat(acc["tail"], s["before"])
        window = F.right(seen, F.lit(LOOK_BACK))
        kind = (
            F.when(s["digits"] >= 12, "CARD_NUMBER")
            .when(s["after"].rlike(CURRENCY), F.lit(None).cast("string"))
            .when(s["digits"].between(3, 8) & window.rlike(CUE), "OTP_OR_PIN")
        )
        shown = (
            F.when(kind == "CARD_NUMBER", vocab.CARD_MASK)
            .when(kind == "OTP_OR_PIN", vocab.CODE_MASK)
            .otherwise(s["run"])
        )
        return F.struct(
            F.concat(acc["text"], s["before"], shown).alias("text"),
            F.right(F.concat(seen, s["run"]), F.lit(LOOK_BACK)).alias("tail"),
            F.when(kind.isNull(), acc["labels"])
            .otherwise(F.array_append(acc["labels"], kind)).alias("labels"),
        )

    def finish(acc: Column) -> Column:
        return F.struct(
            F.concat(acc["text"], F.element_at(pieces, -1)).alias("text"),
            acc["labels"].alias("labels"),
        )

    return F.aggregate(steps, start, step, finish)


def mask(text: Column) -> Column:
    """Masked text; null becomes empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(
        mask_sensitive(text)["text"]
    )


def mask_all(texts: Column) -> Column:
    return F.transform(texts, mask)
