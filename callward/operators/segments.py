"""Raw turns to ordered, timed, cleaned segments, and per-call text profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callward import vocab
from callward.functions import text as T
from callward.operators.prefix import BLOCK, blocks_of, running


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def speaking_time(text: Column) -> Column:
    return F.greatest(F.lit(2.0), F.least(F.lit(9.0), F.length(text) / 14.0))


def from_turns(turns: DataFrame, seconds_per_turn: float = 6.0, clean: bool = True,
               stems: tuple[str, ...] = (), pair: T.LanguagePair = T.LanguagePair(),
               block: int = BLOCK) -> DataFrame:
    """turns(call_id, turn, text, [speaker, start, end, confidence, language, call_direction]).

    Blank turns are dropped, the rest renumbered from 0.  Missing times follow a
    steady cadence from the last known time; `turn` need only be sortable, unique
    within a call and numeric.
    """
    df = turns.select(
        "call_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(_optional(turns, "speaker", "string"), F.lit("UNKNOWN")).alias("speaker"),
        T.strip(F.col("text")).alias("text_original"),
        *[F.col(c).cast("double").alias(f"_{c}") for c in ("start", "end") if c in turns.columns],
        F.greatest(F.lit(0.0), F.least(
            F.lit(1.0), F.coalesce(_optional(turns, "confidence", "double"), F.lit(1.0)))).alias("confidence"),
        _optional(turns, "language", "string").alias("reported"),
        F.coalesce(_optional(turns, "call_direction", "string"), F.lit("unknown")).alias("call_direction"),
    ).filter(F.col("text_original") != "")
    df = timeline(df, seconds_per_turn, block)
    if clean:
        df = T.normalize(df.withColumn("text", F.col("text_original")), "text", stems)
        df = df.drop("text").withColumnRenamed("text_clean", "text")
    else:
        empty = F.array().cast("array<string>")
        df = df.withColumns({"text": F.col("text_original"), "notes": empty, "reverted": empty})
    language = T.reconcile_language(F.col("reported"), T.detect_language(F.col("text"), pair))
    return df.select(
        "call_id", "seq", "speaker", "start", "end", language.alias("language"), "text",
        "text_original", "confidence", "notes", "reverted", "call_direction",
    )


def timeline(df: DataFrame, seconds_per_turn: float = 6.0, block: int = BLOCK) -> DataFrame:
    """Number the rows of each call and fill in missing start and end times.

    A given start, or the previous row's given end, anchors the clock; from an
    anchor on, starts advance by the cadence of the rows in between.
    """
    d = speaking_time(F.col("text_original"))
    blk = blocks_of(F.col("turn"), block)
    gap = F.greatest(F.lit(seconds_per_turn), d + 0.6)
    kept = [c for c in df.columns if c not in ("_start", "_end")]
    if "_start" not in df.columns and "_end" not in df.columns:
        df = running(df, ["call_id"], ["turn"], blk, {"seq": ("count", F.lit(1)), "_elapsed": ("sum", gap)})
        start = 1.5 + F.col("_elapsed")
        return df.select(*kept, "seq", start.alias("start"), (start + d).alias("end"))
    df = df.select(*kept, *[
        F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("_start", "_end")])
    df = running(df, ["call_id"], ["turn"], blk, {
        "seq": ("count", F.lit(1)),
        "_elapsed": ("sum", gap),
        "_prev": ("last", F.col("_end") + F.greatest(seconds_per_turn - d, F.lit(0.6))),
    })
    anchor = F.coalesce(F.col("_start"), F.col("_prev"), F.when(F.col("seq") == 0, 1.5))
    df = running(df, ["call_id"], ["turn"], blk, {
        "_origin": ("last_known", anchor - F.col("_elapsed")),
    }, inclusive=True)
    start = F.coalesce(F.col("_start"), F.col("_origin") + F.col("_elapsed"))
    return df.select(*kept, "seq", start.alias("start"), F.greatest(start, F.coalesce(F.col("_end"), start + d)).alias("end"))


def language_profile(segments: DataFrame) -> DataFrame:
    """Per call: share of segments per language (3 dp) and the dominant language."""
    agg = segments.groupBy("call_id").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("language") == x).alias(f"n_{x}") for x in vocab.LANGUAGES],
    )
    share = {x: F.round(F.col(f"n_{x}") / F.col("n"), 3) for x in sorted(vocab.LANGUAGES)}
    present = F.array_compact(F.array(*[
        F.when(F.col(f"n_{x}") > 0, F.struct(F.lit(x), s)) for x, s in share.items()
    ]))
    top = F.greatest(*share.values())
    first = F.coalesce(*[F.when(s == top, F.lit(x)) for x, s in share.items()])
    dominant = F.when(
        (share["mixed"] >= 0.25) | ((share["kk"] > 0.2) & (share["ru"] > 0.2)), "mixed"
    ).otherwise(first)
    return agg.select("call_id", F.map_from_entries(present).alias("profile"), dominant.alias("dominant"))


def render_line(normalized: bool = True, with_confidence: bool = False) -> Column:
    body = F.col("text" if normalized else "text_original")
    suffix = F.format_string(" (asr=%.2f)", F.col("confidence")) if with_confidence else F.lit("")
    return F.concat(
        F.lit("["), T.fmt_ts(F.col("start")), F.lit("] "), "speaker", F.lit(" ("), "language",
        F.lit(")"), suffix, F.lit(": "), body,
    )


def transcript_lines(segments: DataFrame, normalized: bool = True, with_confidence: bool = False) -> DataFrame:
    """(call_id, seq, line): the transcript as rows, however long a call is."""
    return segments.select("call_id", "seq", render_line(normalized, with_confidence).alias("line"))


def render(segments: DataFrame, normalized: bool = True, with_confidence: bool = False) -> DataFrame:
    """Transcript text, one row per call: the form of a prompt or a file.

    Work that doesn't need one text per call uses `transcript_lines`.
    """
    rows = transcript_lines(segments, normalized, with_confidence)
    return rows.groupBy("call_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("transcript")
    )


INSTRUCTION = "Analyse this telephone conversation and answer with one JSON object."
SYSTEM_PROMPT = "You find social-engineering patterns in calls and quote your evidence."


def prompts(segments: DataFrame, facts: DataFrame, dominant: DataFrame,
            instruction: str = INSTRUCTION) -> DataFrame:
    """User prompt per call: instruction, metadata, transcript."""
    meta = F.concat_ws(
        "\n",
        F.concat(F.lit("call_direction: "), "call_direction"),
        F.concat(F.lit("dominant_language: "), "dominant"),
        F.concat(F.lit("duration_seconds: "), F.floor("duration").cast("string")),
        F.when(F.col("mean_confidence") < 0.8,
               F.format_string("mean_asr_confidence: %.2f (noisy transcript)", F.col("mean_confidence"))),
    )
    return (
        render(segments, with_confidence=True)
        .join(facts, "call_id").join(dominant.select("call_id", "dominant"), "call_id")
        .select("call_id", F.concat_ws(
            "\n\n", F.lit(instruction), F.concat(F.lit("METADATA\n"), meta),
            F.concat(F.lit("TRANSCRIPT\n"), "transcript")).alias("prompt"))
    )


def messages(prompt: Column, target: Column, system: str = SYSTEM_PROMPT) -> Column:
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(turn("system", F.lit(system)), turn("user", prompt), turn("assistant", target))


def flags(segments: DataFrame, low_confidence: float = 0.55) -> DataFrame:
    """Low-ASR flag per segment; a `diarization_confidence` below one half adds a note."""
    out = segments.withColumn("low_asr", F.col("confidence") < low_confidence)
    if "diarization_confidence" in segments.columns:
        c = F.col("diarization_confidence")
        out = out.withColumn("diarization_note", F.when(
            c < 0.5, F.format_string("low diarization confidence (%.2f)", c)))
    return out
