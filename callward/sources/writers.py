"""DataFrames to files: corpora, slices, replay exports, reports, audit rows, stored tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from callward.functions import text as T
from callward.operators import store

BUCKETS = 64


def jsonl(df: DataFrame, path: str) -> int:
    """Write JSON lines and return the row count, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def by_split(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy("split").json(path)


def slice_rows(records: DataFrame) -> DataFrame:
    """Test records once per slice they carry."""
    return records.filter("split = 'test'").withColumn("slice", F.explode(F.array_distinct("slices")))


def by_slice(records: DataFrame, path: str) -> None:
    slice_rows(records).write.mode("overwrite").partitionBy("slice").json(path)


def replay_rows(records: DataFrame) -> DataFrame:
    """Replay form of dataset records: selected fields and the original text."""
    lines = F.transform("segments", lambda s: F.struct(
        s["speaker"].alias("speaker"), s["start"].alias("start"), s["end"].alias("end"),
        s["language"].alias("language"), s["text_original"].alias("text"), s["confidence"].alias("confidence")))
    return records.select(
        "call_id", "call_direction", "family", "family_label", "language_mode", "asr_noisy",
        F.col("gold.classification").alias("expected_classification"), lines.alias("segments"))


def replay(records: DataFrame, path: str) -> None:
    replay_rows(records).write.mode("overwrite").json(path)


def report(metric_rows: DataFrame, path: str) -> None:
    metric_rows.repartition(1).write.mode("overwrite").json(path)


def audit_rows(calls: DataFrame, action: str, actor: str, detail: Column) -> DataFrame:
    return calls.select(
        F.current_timestamp().alias("at"), F.lit(actor).alias("actor"), F.lit(action).alias("action"),
        F.col("call_id").cast("string").alias("call_id"), detail.cast("string").alias("detail"))


def audit(calls: DataFrame, path: str, action: str, actor: str = "system", detail: Column | None = None,
          run_id: str | None = None) -> None:
    """Append one audit row per call.

    Rows lie in a folder of their run.  A job that is run again under the same `run_id` writes that folder anew
    instead of adding to it; without one every call is a run of its own.
    """
    run_id = uuid.uuid4().hex if run_id is None else run_id
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"run id {run_id!r}: letters, digits, '_', '.' and '-' only")
    audit_rows(calls, action, actor, F.lit("") if detail is None else detail).write.mode("overwrite").parquet(f"{path}/run={run_id}")


def audited_read(calls: DataFrame, segments: DataFrame, ids: DataFrame, key: Column | None, path: str, run_id: str,
                 actor: str) -> DataFrame:
    """Decrypted segments of the wanted calls that aren't deleted; who read what is written first.

    The audit row of a call tells how many segments were read and how many originals the key opened.  If writing
    it fails, nothing is returned; a read that is repeated under its run id leaves one row per call.
    """
    wanted = store.visible(calls).join(ids.select("call_id"), "call_id", "left_semi").select("call_id")
    text = segments.join(wanted, "call_id", "left_semi").withColumn(
        "text_original", store.decrypted(F.col("text_encrypted"), key)).drop("text_encrypted")
    read = text.groupBy("call_id").agg(F.count("*").alias("n"), F.count("text_original").alias("opened"))
    rows = wanted.join(read, "call_id", "left").select("call_id", F.format_string(
        "segments=%d opened=%d", F.coalesce("n", F.lit(0)), F.coalesce("opened", F.lit(0))).alias("detail"))
    audit(rows, path, "read_transcript", actor, F.col("detail"), run_id)
    return text


# --- stored tables -----------------------------------------------------------------
# A table is a folder of versions `v000000000007`.  A version counts once the file MARK stands in it, which is
# written last; readers take the newest that counts.

MARK = "_CURRENT"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> tuple[list[str], str | None]:
    """(all versions in order, the newest that counts)."""
    store_, where = _files(spark, path)
    if not store_.exists(where):
        return [], None
    found = sorted(f.getPath().getName() for f in store_.listStatus(where) if re.fullmatch(r"v\d{12}", f.getPath().getName()))
    whole = [v for v in found if store_.exists(_files(spark, f"{path}/{v}/{MARK}")[1])]
    return found, whole[-1] if whole else None


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(F.col("call_id").cast("string")), F.lit(buckets)).cast("int"))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored content; an error where nothing has been saved."""
    _, current = _versions(spark, path)
    if current is None:
        raise FileNotFoundError(f"no stored table at {path}")
    return spark.read.parquet(f"{path}/{current}").drop("bucket")


def save_table(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Make `df` the whole content of the table: what it no longer holds is gone from the files.

    The content is written beside the old one, which stays in place until the new one is whole; then it is
    deleted, and so is what failed jobs have left.  A job that ends in between leaves the old content or the new.
    `df` may be derived from the table itself.  Of two jobs that save at once one fails.  Rows are dealt by size, the
    same call next to each other.
    """
    spark = df.sparkSession
    found, current = _versions(spark, path)
    number = int(current[1:]) + 1 if current else 0
    store_, target = _files(spark, f"{path}/v{number:012d}")
    if f"v{number:012d}" in found:  # of a job that failed
        store_.delete(target, True)
    (with_bucket(df, buckets).hint("rebalance", "bucket").sortWithinPartitions("bucket", "call_id")
        .write.mode("errorifexists").partitionBy("bucket").parquet(target.toString()))
    store_.create(_files(spark, f"{target.toString()}/{MARK}")[1], False).close()
    for old in found:
        if old != f"v{number:012d}":
            store_.delete(_files(spark, f"{path}/{old}")[1], True)


def append_table(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Add rows to the newest version; the first rows make a table."""
    _, current = _versions(df.sparkSession, path)
    if current is None:
        save_table(df, path, buckets)
    else:
        with_bucket(df, buckets).write.mode("append").partitionBy("bucket").parquet(f"{path}/{current}")


# --- text outputs ----------------------------------------------------------------

def public_json(verdict: DataFrame, factors: DataFrame) -> DataFrame:
    """The nine public fields of a verdict as JSON, one row per call.

    factors(call_id, sec, category, ...); the list is keyed by (category, second).
    """
    listed = factors.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct(
        "sec", "category", F.struct(
            T.fmt_ts(F.col("sec")).alias("timestamp"), "speaker", "category", "severity", "evidence", "reason",
        ).alias("f")))).alias("l"))
    fields = F.struct(
        "classification", F.bround("confidence", 2).alias("confidence"), "scam_types", "tactics",
        F.col("stage").alias("conversation_stage"), "requested_actions",
        F.coalesce(F.transform("l", lambda x: x["f"]), F.array()).alias("risk_factors"),
        "explanation", "recommended_action")
    return verdict.join(listed, "call_id", "left").select("call_id", F.to_json(fields).alias("payload"))


def update_frames(updates: DataFrame, newest: DataFrame, alerts: DataFrame) -> DataFrame:
    """Live update frame per (call, update): base fields, newest event, alert if any."""
    df = updates.join(newest, ["call_id", "upd"], "left").join(alerts, ["call_id", "upd"], "left")
    frame = F.struct(
        F.lit("risk_update").alias("type"), "call_id", "risk_score",
        F.col("risk_level").alias("classification"), F.col("model_classification"),
        F.col("stage").alias("current_stage"), F.col("all_tactics").alias("detected_tactics"),
        F.col("peak").alias("peak_risk_score"), F.col("n_seen").alias("segments_seen"), "event", "alert")
    return df.select("call_id", "upd", F.to_json(frame).alias("frame"))


def report_lines(assessed: DataFrame, partitioned: DataFrame, ledger: DataFrame, segments: DataFrame) -> DataFrame:
    """Investigation report as ordered lines: (call_id, section, ord, line).

    Lines instead of one text keep a call of any length distributed; sort by
    (section, ord) when writing a report out.
    """
    def row(section: int, ord_: Column, line: Column, df: DataFrame) -> DataFrame:
        return df.select("call_id", F.lit(section).alias("section"), ord_.cast("double").alias("ord"), line.alias("line"))

    facts = [
        F.concat(F.lit("# Investigation report for call "), F.col("call_id").cast("string")),
        F.concat(F.lit("| Risk | `"), T.score_bar(F.col("risk_score")), F.lit("` "), "risk_score", F.lit("/100 "), "risk_level", F.lit(" |")),
        F.concat(F.lit("| Verdict | "), "classification", F.format_string(" (confidence %.2f) |", F.col("confidence"))),
        F.concat(F.lit("| Scam types | "), F.array_join("scam_types", ", "), F.lit(" |")),
        F.concat(F.lit("| Tactics | "), F.array_join("tactics", ", "), F.lit(" |")),
        F.concat(F.lit("| Stage | "), "stage", F.lit(" |")),
        F.format_string("| Duration | %ds, %d segments |", F.floor("duration"), F.col("n_segments")),
        F.concat(F.lit("| Direction | "), "call_direction", F.lit(" |")),
        F.format_string("| Mean ASR confidence | %.2f |", F.col("mean_confidence")),
        F.when(F.col("disagreement").isNotNull(), F.concat(F.lit("> Disagreement: "), "disagreement")),
    ]
    head = assessed.select("call_id", F.posexplode(F.array_compact(F.array(*facts))).alias("o", "line"))
    actions = assessed.select("call_id", F.posexplode("requested_actions").alias("o", "a"))
    bar = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("\\|"))
    event = F.concat(
        F.lit("| `"), T.fmt_ts(F.col("sec")), F.lit("` | "), "speaker", F.lit(" | "), "category", F.lit(" | "),
        "severity", F.lit(" | "), bar("evidence"), F.lit(" |"))
    entry = F.concat(F.format_string("| %+.1f | ", F.col("points")), "label", F.lit(" | "), bar("detail"), F.lit(" |"))
    said = F.concat(F.lit("["), T.fmt_ts(F.col("start")), F.lit("] "), "speaker", F.lit(": "), "text")
    return (
        row(1, F.col("o"), F.col("line"), head)
        .unionByName(row(2, F.col("o"), F.concat(F.lit("- "), "a"), actions))
        .unionByName(row(3, F.col("sec"), event, partitioned))
        .unionByName(row(4, -F.abs("points"), entry, ledger))
        .unionByName(row(5, F.col("seq"), said, segments))
    )
