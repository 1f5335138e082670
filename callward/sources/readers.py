"""Files to DataFrames, with explicit schemas."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from callward import vocab
from callward.functions import text as X
from callward.operators import validate

SEGMENT = "struct<speaker:string,start:double,end:double,language:string,text:string,confidence:double>"
REPLAY = (
    f"call_id string, call_direction string, family string, family_label string, language_mode string, "
    f"asr_noisy boolean, expected_classification string, segments array<{SEGMENT}>"
)
FACTOR = "struct<timestamp:string,speaker:string,category:string,severity:string,evidence:string,reason:string>"
GOLD = (
    "struct<classification:string,confidence:double,scam_types:array<string>,tactics:array<string>,"
    "conversation_stage:string,requested_actions:array<string>,explanation:string,"
    f"recommended_action:string,risk_factors:array<{FACTOR}>>"
)
RECORD = (
    "call_id string, call_direction string, family string, family_label string, language_mode string, "
    "asr_noisy boolean, difficulty string, slices array<string>, dominant_language string, split string, "
    "segments array<struct<speaker:string,start:double,end:double,timestamp:string,language:string,"
    "text:string,text_original:string,confidence:double>>, "
    f"messages array<struct<role:string,content:string>>, gold {GOLD}"
)


def replay_calls(spark: SparkSession, path: str) -> DataFrame:
    """One call per JSON file; files that do not parse are skipped."""
    raw = spark.read.schema(REPLAY).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return raw.select(F.coalesce("call_id", stem).alias("call_id"), *[c for c in raw.columns if c != "call_id"])


def turns_of(calls: DataFrame) -> DataFrame:
    """Nested segments as turn rows."""
    return calls.select("call_id", "call_direction", F.posexplode("segments").alias("turn", "s")).select(
        "call_id", "call_direction", F.col("turn").cast("bigint").alias("turn"), "s.*")


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines corpus with the text of malformed lines in `rejected`; blank lines are ignored."""
    return spark.read.schema(RECORD + ", rejected string").option("columnNameOfCorruptRecord", "rejected").json(path)


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines corpus; a malformed line or a missing path is an error."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def annotated_calls(spark: SparkSession, path: str) -> DataFrame:
    """Drop folder of annotated calls: `segments` and `gold` required, the rest defaulted."""
    raw = spark.read.schema(RECORD).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    df = raw.withColumn("_stem", stem).filter("segments is not null and gold is not null")
    confidence = F.aggregate(
        "segments", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["confidence"], F.lit(1.0))
    ) / F.greatest(F.size("segments"), F.lit(1))
    return df.select(
        F.coalesce("call_id", "_stem").alias("call_id"),
        F.coalesce("call_direction", F.lit("unknown")).alias("call_direction"),
        F.coalesce("family", F.concat(F.lit("real::"), "_stem")).alias("family"),
        F.coalesce("family_label", F.lit("real annotated call")).alias("family_label"),
        "language_mode",
        F.coalesce("asr_noisy", (F.size("segments") > 0) & (confidence < 0.8)).alias("asr_noisy"),
        F.coalesce("difficulty", F.lit("real")).alias("difficulty"),
        F.coalesce("slices", F.array(F.lit("real"))).alias("slices"),
        F.when(F.col("split").isin("train", "validation", "test"), F.col("split")).otherwise("train").alias("split"),
        "segments", "gold",
    )


def parse_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Pasted `SPEAKER: words` lines to turns; other lines are kept whole as UNKNOWN.

    Adds (turn, speaker, text) to the remaining columns.
    """
    keep = [c for c in df.columns if c != text]
    lines = df.select(*keep, F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("turn", "_raw"))
    lines = lines.withColumn("_line", X.strip(F.col("_raw"))).filter("_line <> ''")
    name = F.upper(X.strip(F.regexp_extract("_line", r"(?s)^([^:]*):", 1)))
    body = X.strip(F.regexp_extract("_line", r"(?s)^[^:]*:(.*)$", 1))
    known = name.isin(*vocab.SPEAKERS) & (body != "")
    return lines.select(
        *keep, F.col("turn").cast("bigint").alias("turn"),
        F.when(known, name).otherwise("UNKNOWN").alias("speaker"),
        F.when(known, body).otherwise(F.col("_line")).alias("text"))


def eval_reports(spark: SparkSession, path: str) -> DataFrame:
    """Headline metrics of saved evaluation reports; unparseable files are skipped."""
    metric = "scam_recall_risk_engine double, false_positive_rate_risk_engine double, json_validity double"
    schema = f"backend string, split string, overall struct<{metric.replace(' double', ':double')}>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return raw.filter("overall is not null").select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("report"),
        "backend", "split", "overall.*")


# --- model completions ---------------------------------------------------------

COMPLETION = (
    "classification string, confidence double, scam_types array<string>, tactics array<string>, "
    "conversation_stage string, requested_actions array<string>, explanation string, "
    f"recommended_action string, risk_factors array<{FACTOR}>, _bad string"
)
PARSE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}


LISTS = ("scam_types", "tactics", "requested_actions")


def _plain(value: dict) -> dict:
    """Lists given as one text become lists, numbers given as text become numbers."""
    out = dict(value)
    for name in LISTS:
        if isinstance(out.get(name), str):
            out[name] = [out[name]]
    if isinstance(out.get("confidence"), str):
        try:
            out["confidence"] = float(out["confidence"])
        except ValueError:
            pass
    return out


@pandas_udf(StringType())
def first_object(text: pd.Series) -> pd.Series:
    """The text's JSON object, or else the first that begins at its first brace; null where none parses."""
    decoder = json.JSONDecoder()

    def found(s: str) -> str | None:
        for at in (0, s.find("{")):
            if at < 0 or s[at:at + 1] != "{":
                continue
            try:
                value, end = decoder.raw_decode(s, at)
            except ValueError:
                continue
            return json.dumps(_plain(value), ensure_ascii=False)
        return None

    return text.map(found)


def completions(df: DataFrame, raw: str = "completion") -> DataFrame:
    """Model completions to validated verdict rows.

    Code fences are stripped; a text that is not one JSON object is searched for
    its first object.  Rows that still fail, or break a required range or label, are
    flagged `invalid_json` with the first 200 characters.
    """
    fence = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.col(raw).rlike(r"(?s)```.*?```"), X.strip(fence)).otherwise(X.strip(F.coalesce(raw, F.lit(""))))
    df = df.withColumn("_body", body)
    df = df.withColumn("_v", F.from_json(first_object("_body"), COMPLETION, PARSE))
    v = lambda c: F.col(f"_v.{c}")
    cls, conf = F.coalesce(v("classification"), F.lit("SAFE")), F.coalesce(v("confidence"), F.lit(0.0))
    factors = F.coalesce(v("risk_factors"), F.array().cast(f"array<{FACTOR}>"))
    known = F.forall(factors, lambda f: F.upper(X.strip(F.coalesce(f["category"], F.lit("")))).isin("", *vocab.CATEGORIES))
    said = lambda f, name: F.upper(X.strip(F.coalesce(f[name], F.lit(""))))
    known = known & F.forall(factors, lambda f: said(f, "severity").isin("", *vocab.SEVERITIES) & said(f, "speaker").isin("", *vocab.SPEAKERS))
    ok = F.col("_v").isNotNull() & v("_bad").isNull() & cls.isin(*vocab.CLASSIFICATIONS) & conf.between(0.0, 1.0) & known
    none = F.array().cast("array<string>")
    return df.withColumn("valid", F.coalesce(ok, F.lit(False))).select(
        *[c for c in df.columns if not c.startswith("_")], "valid",
        F.when(F.col("valid"), cls).otherwise("SAFE").alias("classification"),
        F.when(F.col("valid"), conf).otherwise(0.0).alias("confidence"),
        F.when(F.col("valid"), validate.clean_labels(v("scam_types"), vocab.SCAM_TYPES)).otherwise(none).alias("scam_types"),
        F.when(F.col("valid"), validate.clean_labels(v("tactics"), vocab.TACTICS)).otherwise(none).alias("tactics"),
        F.when(F.col("valid"), validate.clean_stage(v("conversation_stage"))).otherwise("UNKNOWN").alias("stage"),
        F.when(F.col("valid"), factors).otherwise(F.array().cast(f"array<{FACTOR}>")).alias("risk_factors"),
        F.when(~F.col("valid"), F.concat(F.lit("invalid_json: "), F.substring(F.coalesce(raw, F.lit("")), 1, 200))).alias("dropped"),
    )


def completion_events(verdicts: DataFrame, key: str = "call_id") -> DataFrame:
    """Risk factors of validated completions as event rows, ready for grounding."""
    return verdicts.select(F.col(key).alias("call_id"), F.posexplode("risk_factors").alias("quote_id", "f")).select(
        "call_id", "quote_id", "f.evidence", F.upper(X.strip(F.col("f.category"))).alias("category"),
        F.coalesce("f.severity", F.lit("LOW")).alias("severity"), F.coalesce("f.reason", F.lit("")).alias("reason"),
        "f.timestamp", "f.speaker")


def browse(calls: DataFrame, language: str | None = None, noisy: bool | None = None) -> DataFrame:
    out = calls if language is None else calls.filter(F.col("language_mode") == language)
    return out if noisy is None else out.filter(F.coalesce("asr_noisy", F.lit(False)) == noisy)


def by_speaker(segments: DataFrame, speaker: str) -> DataFrame:
    return segments.filter(F.col("speaker") == speaker)


