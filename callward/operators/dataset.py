"""Labelled corpora: leakage-safe splits, gold roll-ups, records, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callward import vocab
from callward.functions import text as T
from callward.operators.prefix import running
from callward.operators.verdict import ACTION_TEXT, RECOMMENDED_ACTION, lookup

SPLITS = ("train", "validation", "test")


def split_families(families: DataFrame, seed: int = 20260809,
                   ratios: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """families(family, class, holdout) -> split, whole families only.

    Per class: holdouts go to test, the others are ordered by a seeded hash and
    cut into quotas of at least one family each.
    """
    pool = families.filter(~F.col("holdout")).withColumn(
        "_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("family").cast("string"))))
    totals = pool.groupBy("class").agg(F.count("*").alias("n"))
    n = F.col("n")
    val = F.greatest(F.lit(1), F.bround(n * ratios[1]).cast("bigint"))
    test = F.greatest(F.lit(1), F.bround(n * ratios[2]).cast("bigint"))
    tiny = n - val - test < 1
    quotas = totals.select(
        "class",
        F.when(tiny, F.greatest(F.lit(1), n - 2)).otherwise(n - val - test).alias("n_train"),
        F.when(tiny, F.least(F.lit(1), n - 1)).otherwise(val).alias("n_val"),
    )
    block = F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint")
    ranked = running(pool, ["class"], ["_h", "family"], block, {"_i": ("count", F.lit(1))})
    cut = ranked.join(F.broadcast(quotas), "class").select("family", "class", (
        F.when(F.col("_i") < F.col("n_train"), "train")
        .when(F.col("_i") < F.col("n_train") + F.col("n_val"), "validation").otherwise("test")).alias("split"))
    held = families.filter("holdout").select("family", "class", F.lit("test").alias("split"))
    return cut.unionByName(held)


def slices(language: Column, difficulty: Column, is_scam: Column, noisy: Column, holdout: Column) -> Column:
    """Evaluation slices of a record, in order and without repeats."""
    return F.array_distinct(F.array_compact(F.array(
        language, difficulty, F.when(is_scam, "scam").otherwise("legitimate"),
        F.when(noisy, F.lit("asr_noisy")), F.when(holdout, F.lit("unseen_pattern")),
    )))


def annotated_events(annotations: DataFrame, segments: DataFrame) -> DataFrame:
    """Turn annotations joined to their segment, so evidence is verbatim transcript text.

    annotations(call_id, seq, ord, category, severity)
    """
    return annotations.join(segments.select("call_id", "seq", "speaker", "start", "text"), ["call_id", "seq"]).select(
        "call_id", "seq", "ord", "speaker", T.fmt_ts(F.col("start")).alias("timestamp"),
        "category", "severity", F.col("text").alias("evidence"))


def gold_rollup(annotations: DataFrame, stages: DataFrame, calls: DataFrame) -> DataFrame:
    """Gold verdict per call from turn annotations.

    annotations(call_id, seq, ord, category); stages(call_id, seq, speaker, stage);
    calls(call_id, gold_class, difficulty, noisy, scam_types).  Per call only one row
    per category survives the first aggregation, so the ordered lists are short.
    """
    is_scam = F.col("gold_class") == "SCAM"
    first = annotations.groupBy("call_id", "category").agg(F.min(F.struct("seq", "ord")).alias("at"))
    cats = first.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("at", "category"))).alias("c"))
    depth = F.expr(lookup("stage", vocab.STAGE_DEPTH, "0"))
    claims = (F.col("stage") == "IDENTITY_CLAIM") & (F.col("speaker") == "CALLER")
    staged = stages.groupBy("call_id").agg(
        F.max(depth).alias("_depth"), F.min(F.when(claims, F.col("seq"))).alias("identity_seq"))
    df = calls.join(cats, "call_id", "left").join(staged, "call_id", "left")
    names = F.coalesce(F.transform("c", lambda x: x["category"]), F.array().cast("array<string>"))
    with_identity = F.when(
        is_scam & F.col("identity_seq").isNotNull(), F.array_append(names, F.lit("IMPERSONATION"))).otherwise(names)

    def mapped(table: dict[str, str]) -> Column:
        return F.expr(f"array_distinct(array_compact(transform(categories, c -> {lookup('c', table)})))")

    df = df.withColumn("categories", F.array_distinct(with_identity))
    tactics = mapped(vocab.CATEGORY_TACTIC)
    authority = F.arrays_overlap("scam_types", F.array(*[F.lit(s) for s in vocab.IMPERSONATION_SCAM_TYPES]))
    confidence = F.when(~is_scam, 0.88).when(F.col("difficulty") == "obvious", 0.90).otherwise(0.74)
    return df.select(
        "call_id", "gold_class",
        F.round(confidence - F.when(F.col("noisy"), 0.08).otherwise(0.0), 2).alias("confidence"),
        "scam_types", "categories",
        F.when(authority & ~F.array_contains(tactics, "AUTHORITY"), F.array_append(tactics, F.lit("AUTHORITY")))
        .otherwise(tactics).alias("tactics"),
        F.expr(lookup("coalesce(_depth, 0)", {d: s for s, d in vocab.STAGE_DEPTH.items()})).alias("stage"),
        mapped(ACTION_TEXT).alias("requested_actions"),
        "identity_seq",
        F.expr(lookup("gold_class", RECOMMENDED_ACTION)).alias("recommended_action"),
    )


def assign_split(records: DataFrame, assignment: DataFrame) -> DataFrame:
    """Family decides the split; a declared split of an unassigned record is kept, else train."""
    declared = F.col("declared_split") if "declared_split" in records.columns else F.lit(None).cast("string")
    out = records.join(assignment.select("family", F.col("split").alias("_s")), "family", "left")
    fallback = F.when(declared.isin(*SPLITS), declared).otherwise("train")
    return out.withColumn("split", F.coalesce("_s", fallback)).drop("_s")


def gold_factors(events: DataFrame, gold: DataFrame, segments: DataFrame) -> DataFrame:
    """Risk factors per call from annotated events: (call_id, risk_factors), the identity claim of a scam first.

    events(call_id, seq, ord, speaker, timestamp, category, severity, evidence, [reason]).
    """
    reason = F.col("reason") if "reason" in events.columns else F.lit("")
    rows = events.select("call_id", F.lit(1).alias("k"), "seq", F.col("ord").cast("long").alias("ord"), "timestamp", "speaker",
                         "category", "severity", "evidence", reason.cast("string").alias("reason"))
    claimed = gold.filter("gold_class = 'SCAM' AND identity_seq IS NOT NULL").select("call_id", F.col("identity_seq").alias("seq"))
    claim = segments.join(claimed, ["call_id", "seq"]).select(
        "call_id", F.lit(0).alias("k"), "seq", F.lit(0).cast("long").alias("ord"), T.fmt_ts(F.col("start")).alias("timestamp"), "speaker",
        F.lit("IMPERSONATION").alias("category"), F.lit("HIGH").alias("severity"), F.col("text").alias("evidence"),
        F.lit("").alias("reason"))
    listed = rows.unionByName(claim).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct(
        "k", "seq", "ord", F.struct("timestamp", "speaker", "category", "severity", "evidence", "reason").alias("f")))).alias("l"))
    return listed.select("call_id", F.transform("l", lambda x: x["f"]).alias("risk_factors"))


def build_records(segments: DataFrame, calls: DataFrame, gold: DataFrame, prompts: DataFrame,
                  factors: DataFrame | None = None) -> DataFrame:
    """Dataset rows, one per call: transcript, gold verdict and chat messages.

    `factors` (of `gold_factors`) and an `explanation` column of `gold` are optional.  The answer in
    the messages is the gold verdict as JSON.
    """
    from callward.operators.segments import messages

    listed = segments.groupBy("call_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "seq", "speaker", "start", "end", T.fmt_ts(F.col("start")).alias("timestamp"),
            "language", "text", "text_original", "confidence"))).alias("l"))
    listed = listed.select("call_id", F.transform("l", lambda x: x.dropFields("seq")).alias("segments"))
    none = F.array().cast("array<string>")

    def given(name: str, default: Column, of: str | None = None) -> Column:
        return F.coalesce(of or name, default) if (of or name) in gold.columns else default

    factor = "array<struct<timestamp:string,speaker:string,category:string,severity:string,evidence:string,reason:string>>"
    if factors is None:
        gold = gold.withColumn("risk_factors", F.array().cast(factor))
    else:
        gold = gold.drop("risk_factors").join(factors, "call_id", "left")
    verdict = F.struct(
        F.col("gold_class").alias("classification"), F.col("confidence").alias("confidence"),
        given("scam_types", none).alias("scam_types"), given("tactics", none).alias("tactics"),
        given("conversation_stage", F.lit("UNKNOWN"), "stage").alias("conversation_stage"),
        given("requested_actions", none).alias("requested_actions"), given("explanation", F.lit("")).alias("explanation"),
        given("recommended_action", F.lit("")).alias("recommended_action"),
        F.coalesce("risk_factors", F.array().cast(factor)).alias("risk_factors"))
    return (
        listed.join(calls, "call_id").join(gold.select("call_id", verdict.alias("gold")), "call_id").join(prompts, "call_id")
        .withColumn("messages", messages(F.col("prompt"), F.to_json("gold"))).drop("prompt")
    )


def split_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(F.count("*").alias("n"))


def slice_counts(records: DataFrame) -> DataFrame:
    return records.select("split", F.explode("slices").alias("slice")).groupBy("split", "slice").agg(
        F.count("*").alias("n"))


def split_families_listed(records: DataFrame) -> DataFrame:
    """Distinct (split, family) rows: the family list of every split."""
    return records.select("split", "family").distinct()


def leakage(records: DataFrame) -> DataFrame:
    """Families that occur in train and in another split."""
    fams = split_families_listed(records)
    train = fams.filter("split = 'train'").select("family")
    return fams.filter("split <> 'train'").join(train, "family", "left_semi")


def hard_negative_share(families: DataFrame) -> DataFrame:
    return families.agg(F.round(F.avg((F.col("class") != "SCAM").cast("int")), 4).alias("share"))


def supervised_examples(tokens: DataFrame, max_len: int) -> DataFrame:
    """tokens(prompt_ids, full_ids): drop over-long rows, mask the prompt out of the labels."""
    return tokens.filter(F.size("full_ids") <= max_len).withColumn(
        "labels",
        F.transform("full_ids", lambda x, i: F.when(i < F.size("prompt_ids"), F.lit(-100).cast("bigint")).otherwise(x.cast("bigint"))))


def manifest(records: DataFrame) -> DataFrame:
    """Long-form manifest: (section, split, key, value)."""
    def part(section: str, df: DataFrame, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), "split", key.cast("string").alias("key"),
                         value.cast("bigint").alias("value"))

    return (
        part("count", split_counts(records), F.lit(""), F.col("n"))
        .unionByName(part("slice", slice_counts(records), F.col("slice"), F.col("n")))
        .unionByName(part("family", split_families_listed(records), F.col("family"), F.lit(1)))
        .unionByName(part("leak", leakage(records), F.col("family"), F.lit(1)))
    )
