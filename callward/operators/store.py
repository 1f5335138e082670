"""Stored calls: masked copies, upserts, reads, deletion, retention, reporting.

Stored tables are plain DataFrames; every change returns the new table content,
and `sources.writers` puts it in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callward import vocab
from callward.functions import masking as M
from callward.functions import text as T
from callward.operators.verdict import severity_rank

CALL_COLUMNS = (
    "call_id", "started_at", "ended_at", "duration", "language", "call_direction", "final_risk",
    "risk_level", "peak_risk", "status", "mean_confidence", "recording_ref",
    "recording_purge_after", "transcript_purge_after", "deleted_at",
)


def encrypted(text: Column, key: Column | None) -> Column:
    """AES-GCM copy of the verbatim text; without a key nothing is kept."""
    if key is None:
        return F.lit(None).cast("binary")
    return F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"))


def decrypted(blob: Column, key: Column | None) -> Column:
    if key is None:
        return F.lit(None).cast("string")
    return F.try_aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def stored_segments(segments: DataFrame, key: Column | None = None) -> DataFrame:
    df = segments.withColumn("_m", M.mask_sensitive(F.col("text")))
    return df.select(
        "call_id", "seq", "speaker", "start", "end", T.fmt_ts(F.col("start")).alias("timestamp"),
        "language", F.col("_m.text").alias("text_masked"),
        encrypted(F.col("text_original"), key).alias("text_encrypted"),
        F.col("_m.labels").alias("masked_labels"), "confidence", "notes",
    )


def stored_events(events: DataFrame) -> DataFrame:
    return events.select(
        "call_id", T.fmt_ts(F.col("sec")).alias("timestamp"), "speaker", "category", "severity",
        M.mask(F.col("evidence")).alias("evidence"), M.mask(F.col("reason")).alias("reason"),
        F.col("segment_index").alias("segment_seq"), "grounding_score",
    )


def masked_fields(df: DataFrame, *columns: str) -> DataFrame:
    """Mask free-text columns; array columns are masked element by element."""
    kinds = dict(df.dtypes)
    return df.withColumns({
        c: M.mask_all(F.col(c)) if kinds[c].startswith("array") else M.mask(F.col(c)) for c in columns
    })


def retention(started: Column, recording_days: int = vocab.RECORDING_RETENTION_DAYS,
              transcript_days: int = vocab.TRANSCRIPT_RETENTION_DAYS) -> dict[str, Column]:
    return {
        "recording_purge_after": started + F.make_interval(days=F.lit(recording_days)),
        "transcript_purge_after": started + F.make_interval(days=F.lit(transcript_days)),
    }


def upsert_calls(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Merge analysed calls into the call table.

    incoming(call_id, duration, language, call_direction, risk_score, risk_level,
    mean_confidence, recording_ref).  First start and end times are kept, the peak
    never falls, retention deadlines follow the start.
    """
    s, i = stored.alias("s"), incoming.alias("i")
    fresh = F.col("i.call_id").isNotNull()

    def new(column: str, source: str | None = None) -> Column:
        return F.when(fresh, F.col(f"i.{source or column}")).otherwise(F.col(f"s.{column}"))

    started = F.coalesce(F.col("s.started_at"), now)
    keep = retention(started)
    return s.join(i, F.col("s.call_id") == F.col("i.call_id"), "full_outer").select(
        F.coalesce("s.call_id", "i.call_id").alias("call_id"),
        started.alias("started_at"),
        F.when(fresh, F.coalesce(F.col("s.ended_at"), now)).otherwise(F.col("s.ended_at")).alias("ended_at"),
        new("duration").alias("duration"), new("language").alias("language"),
        new("call_direction").alias("call_direction"), new("final_risk", "risk_score").alias("final_risk"),
        new("risk_level").alias("risk_level"),
        F.when(fresh, F.greatest(F.coalesce("s.peak_risk", F.lit(0)), "i.risk_score"))
        .otherwise(F.col("s.peak_risk")).alias("peak_risk"),
        F.when(fresh, F.lit("analyzed")).otherwise(F.col("s.status")).alias("status"),
        new("mean_confidence").alias("mean_confidence"), new("recording_ref").alias("recording_ref"),
        *[F.when(fresh, keep[c]).otherwise(F.col(f"s.{c}")).alias(c)
          for c in ("recording_purge_after", "transcript_purge_after")],
        F.col("s.deleted_at").alias("deleted_at"),
    )


def replace_children(stored: DataFrame, incoming: DataFrame, calls: DataFrame) -> DataFrame:
    """Replace the rows of the given calls, so re-analysis cannot duplicate them."""
    kept = stored.join(calls.select("call_id").distinct(), "call_id", "left_anti")
    return kept.unionByName(incoming)


def visible(calls: DataFrame) -> DataFrame:
    return calls.filter("deleted_at is null")


def recent_calls(calls: DataFrame, limit: int = 50, include_deleted: bool = False) -> DataFrame:
    shown = calls if include_deleted else visible(calls)
    return shown.orderBy(F.col("started_at").desc(), F.col("call_id")).limit(limit)


def newest_analysis(analysis: DataFrame) -> DataFrame:
    """Latest analysis row per call, by creation time then id."""
    rest = [c for c in analysis.columns if c not in ("call_id", "created_at", "id")]
    return analysis.groupBy("call_id").agg(
        F.max_by(F.struct("created_at", "id", *rest), F.struct("created_at", "id")).alias("_a")
    ).select("call_id", "_a.*")


def read_call(calls: DataFrame, segments: DataFrame, events: DataFrame, analysis: DataFrame,
              call_id, key: Column | None = None) -> dict[str, DataFrame]:
    """Everything stored about one call; empty tables for an unknown or deleted call."""
    one = visible(calls).filter(F.col("call_id") == F.lit(call_id))
    ids = one.select("call_id")
    mine = lambda df: df.filter(F.col("call_id") == F.lit(call_id)).join(ids, "call_id", "left_semi")
    text = mine(segments)
    if "text_encrypted" in segments.columns:
        text = text.withColumn("text_original", decrypted(F.col("text_encrypted"), key)).drop("text_encrypted")
    return {"call": one, "segments": text, "events": mine(events), "analysis": newest_analysis(mine(analysis))}


def to_segments(stored: DataFrame) -> DataFrame:
    """Segments from stored rows; the masked text stands in for a missing original."""
    return stored.select(
        "call_id", "seq", "speaker", "start", "end", "language", F.col("text_masked").alias("text"),
        F.coalesce("text_original", "text_masked").alias("text_original"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def event_badges(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Every segment with the labels of its events, maybe none.

    Labels repeat per severity only, so a badge list has at most 76 entries.
    """
    marks = events.groupBy("call_id", F.col("segment_index").alias("seq"), "category", "severity").count()
    lists = marks.groupBy("call_id", "seq").agg(F.array_sort(F.collect_list(
        F.struct((-severity_rank()).alias("r"), "category", "severity"))).alias("b"))
    return segments.join(lists, ["call_id", "seq"], "left").withColumn("badges", F.coalesce(
        F.transform("b", lambda x: F.concat_ws(":", x["severity"], x["category"])), F.array().cast("array<string>"))).drop("b")


def soft_delete(calls: DataFrame, segments: DataFrame, events: DataFrame, ids: DataFrame,
                now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tombstone calls and blank their text and evidence."""
    gone = ids.select("call_id").distinct().withColumn("_gone", F.lit(True))

    def mark(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
        out = df.join(gone, "call_id", "left")
        hit = F.col("_gone").isNotNull()
        return out.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_gone")

    blank = F.lit("[deleted]")
    text = {"text_masked": blank}
    if "text_encrypted" in segments.columns:
        text["text_encrypted"] = F.lit(None).cast("binary")
    return mark(calls, {"deleted_at": now}), mark(segments, text), mark(events, {"evidence": blank})


def hard_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove the calls from every table."""
    gone = ids.select("call_id").distinct()
    return {name: df.join(gone, "call_id", "left_anti") for name, df in tables.items()}


def purge_expired(calls: DataFrame, segments: DataFrame, now: Column
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply retention: new calls, new segments, and counts of what changed.

    Only transcripts that still hold text are counted.
    """
    rec_due = F.coalesce(F.col("recording_purge_after") <= now, F.lit(False)) & F.col("recording_ref").isNotNull()
    txt_due = F.coalesce(F.col("transcript_purge_after") <= now, F.lit(False))
    due = calls.filter(txt_due).select("call_id").withColumn("_due", F.lit(True))
    marked = segments.join(due, "call_id", "left")
    hit = F.col("_due").isNotNull()
    live = F.col("text_masked") != "[purged]"
    if "text_encrypted" in segments.columns:
        live = live | F.col("text_encrypted").isNotNull()
    both = calls.filter(rec_due).select(F.lit(1).alias("r"), F.lit(None).cast(calls.schema["call_id"].dataType).alias("call_id")) \
        .unionByName(marked.filter(hit & live).select(F.lit(0).alias("r"), "call_id"))
    counts = both.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("recordings"), F.countDistinct("call_id").alias("transcripts"))
    changes = {"text_masked": F.when(hit, F.lit("[purged]")).otherwise(F.col("text_masked"))}
    if "text_encrypted" in segments.columns:
        changes["text_encrypted"] = F.when(~hit, F.col("text_encrypted"))
    new_calls = calls.withColumn("recording_ref", F.when(~rec_due, F.col("recording_ref")))
    return new_calls, marked.withColumns(changes).drop("_due"), counts


def store_stats(calls: DataFrame, events: DataFrame) -> DataFrame:
    """(section, key, n): total, calls per level, events per category; tombstones included."""
    total = calls.agg(F.count("*").alias("n")).select(F.lit("calls").alias("section"), F.lit("").alias("key"), "n")
    level = calls.groupBy(F.col("risk_level").alias("key")).agg(F.count("*").alias("n"))
    cats = events.groupBy(F.col("category").alias("key")).agg(F.count("*").alias("n"))
    return total.unionByName(level.select(F.lit("risk_level").alias("section"), "key", "n")).unionByName(
        cats.select(F.lit("category").alias("section"), "key", "n"))


def leak_scan(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose stored text still holds something the masking rule would hide."""
    found = F.lit(0)
    for c in columns:
        found = found + F.size(M.mask_sensitive(F.coalesce(F.col(c), F.lit("")))["labels"])
    return df.withColumn("leaks", found).filter("leaks > 0")
