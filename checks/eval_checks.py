"""Checks of evaluation, dataset and split operators (documents x labels, conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from callward import vocab as v
from callward.operators import dataset as D
from callward.operators import evaluate as E
from callward.params import dimension
from callward.sources import writers as W
from checks.common import SQL_SEGMENTS, check, sql_case, sql_in, sql_ts, table
from callward.operators.verdict import ACTION_TEXT

# A document is a call: its length gives a score and a predicted class, its labels the gold class.
_SCORE = "(n_chars * 7) % 101"
_PRED = f"CASE WHEN {_SCORE} >= 70 THEN 'SCAM' WHEN {_SCORE} >= 40 THEN 'SUSPICIOUS' ELSE 'SAFE' END"
_GOLD = "CASE WHEN quality = 0 THEN 'SCAM' WHEN toxic = 1 THEN 'SUSPICIOUS' ELSE 'SAFE' END"
_SQL_CASES = f"""c AS (SELECT doc_id AS call_id, lang, source, n_chars, {_PRED} AS classification, ({_SCORE})::INT AS risk_score,
    {_GOLD} AS gold_class, {_GOLD} = 'SCAM' AS is_scam, toxic FROM documents JOIN labels USING (doc_id))"""


def cases(spark, d):
    docs = table(spark, d, "documents").selectExpr(
        "doc_id AS call_id", "lang", "source", "n_chars", f"{_PRED} AS classification", f"CAST({_SCORE} AS INT) AS risk_score")
    gold = table(spark, d, "labels").selectExpr("doc_id AS call_id", f"{_GOLD} AS gold_class", "toxic")
    return E.cases(docs, gold)


@check("j12_prediction_vs_gold", f"WITH {_SQL_CASES} SELECT call_id, classification, gold_class, risk_score, is_scam FROM c")
def j12(spark, d):
    return cases(spark, d).select("call_id", "classification", "gold_class", "risk_score", "is_scam")


def _sql_metrics(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    hit = {"strict": "classification = 'SCAM'", "flagged": "classification <> 'SAFE'", "risk": "risk_score >= 60"}
    counts = ", ".join(f"count(*) FILTER (is_scam AND {h}) AS tp_{r}, count(*) FILTER (NOT is_scam AND {h}) AS fp_{r}" for r, h in hit.items())
    rates = []
    for r in hit:
        p = f"CASE WHEN tp_{r} + fp_{r} > 0 THEN tp_{r}::DOUBLE / (tp_{r} + fp_{r}) ELSE 0 END"
        q = f"CASE WHEN n_scam > 0 THEN tp_{r}::DOUBLE / n_scam ELSE 0 END"
        rates += [f"round({q}, 4) AS recall_{r}",
                  f"round(CASE WHEN n_legitimate > 0 THEN fp_{r}::DOUBLE / n_legitimate ELSE 0 END, 4) AS fpr_{r}",
                  f"round({p}, 4) AS precision_{r}",
                  f"round(CASE WHEN ({p}) + ({q}) > 0 THEN 2 * ({p}) * ({q}) / (({p}) + ({q})) ELSE 0 END, 4) AS f1_{r}"]
    return f"""m AS (SELECT {lead}count(*) AS n, count(*) FILTER (is_scam) AS n_scam, count(*) FILTER (NOT is_scam) AS n_legitimate,
        count(*) FILTER (classification = gold_class) AS same, coalesce(avg(risk_score) FILTER (is_scam), 0) AS rs,
        coalesce(avg(risk_score) FILTER (NOT is_scam), 0) AS rl, {counts} FROM {source} {group})
      SELECT {lead}n, n_scam, n_legitimate, {', '.join(rates)}, round(same::DOUBLE / n, 4) AS accuracy,
        round(rs, 1) AS mean_risk_scam, round(rl, 1) AS mean_risk_legitimate FROM m"""


@check("a28_decision_metrics", f"WITH {_SQL_CASES}, {_sql_metrics('c')}")
def a28(spark, d):
    return E.decision_metrics(cases(spark, d))


_SLICES = "list_distinct([lang, source, CASE WHEN is_scam THEN 'scam' ELSE 'legitimate' END])"


@check("a31_metrics_by_slice", f"WITH {_SQL_CASES}, s AS (SELECT *, unnest({_SLICES}) AS slice FROM c), {_sql_metrics('s', 'slice')}")
def a31(spark, d):
    slices = F.array("lang", "source", F.when(F.col("is_scam"), "scam").otherwise("legitimate"))
    return E.by_slice(cases(spark, d).withColumn("slices", slices))


_PSET = "[lang, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END, classification]"
_GSET = "['en', CASE WHEN toxic = 1 THEN 'long' ELSE 'short' END, gold_class]"


@check("a29_set_micro", f"""WITH {_SQL_CASES}, p AS (SELECT {_PSET} AS p, {_GSET} AS g FROM c),
    q AS (SELECT count(*) AS n, sum(len(list_intersect(p, g)))::BIGINT AS tp, sum(len(list_filter(p, lambda x: NOT list_contains(g, x))))::BIGINT AS fp,
      sum(len(list_filter(g, lambda x: NOT list_contains(p, x))))::BIGINT AS fn, count(*) FILTER (list_sort(p) = list_sort(g)) AS exact FROM p)
    SELECT n, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 4) AS precision, round(tp::DOUBLE / (tp + fn), 4) AS recall,
      round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) AS f1, round(exact::DOUBLE / n, 4) AS exact_set_match FROM q""")
def a29(spark, d):
    rows = cases(spark, d).withColumns({
        "p": F.array("lang", F.when(F.col("n_chars") < 1000, "short").otherwise("long"), "classification"),
        "g": F.array(F.lit("en"), F.when(F.col("toxic") == 1, "long").otherwise("short"), "gold_class")})
    return E.set_micro(rows, "p", "g")


@check("o02_label_set_difference", f"""WITH {_SQL_CASES} SELECT call_id, array_to_string(list_filter({_PSET}, lambda x: list_contains({_GSET}, x)), '|') AS both,
    array_to_string(list_filter({_PSET}, lambda x: NOT list_contains({_GSET}, x)), '|') AS extra FROM c""")
def o02(spark, d):
    rows = cases(spark, d).withColumns({
        "p": F.array("lang", F.when(F.col("n_chars") < 1000, "short").otherwise("long"), "classification"),
        "g": F.array(F.lit("en"), F.when(F.col("toxic") == 1, "long").otherwise("short"), "gold_class")})
    return rows.select("call_id", F.array_join(F.array_intersect("p", "g"), "|").alias("both"),
                       F.array_join(F.array_except("p", "g"), "|").alias("extra"))


@check("a30_quality_rates", f"""WITH {_SQL_CASES} SELECT count(*) AS n, round(avg((n_chars % 9 <> 0)::INT), 4) AS json_validity,
    round(sum(n_chars % 5)::DOUBLE / greatest(sum(n_chars % 5 + n_chars % 2), 1), 4) AS grounding_rate FROM c""")
def a30(spark, d):
    return E.quality(cases(spark, d).selectExpr(
        "n_chars % 9 <> 0 AS json_valid", "n_chars % 5 AS grounded", "n_chars % 5 + n_chars % 2 AS findings"))


_SWEEP = f"""{_SQL_CASES}, g AS (SELECT unnest(range(10, 100, 5))::INT AS threshold),
  s AS (SELECT threshold, count(*) FILTER (is_scam AND risk_score >= threshold) AS tp, count(*) FILTER (NOT is_scam AND risk_score >= threshold) AS fp,
    count(*) FILTER (NOT is_scam AND risk_score < threshold) AS tn, count(*) FILTER (is_scam AND risk_score < threshold) AS fn FROM c, g GROUP BY threshold),
  r AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS rc, CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END AS fr,
    CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS pr FROM s)"""
_SWEEP_OUT = ("threshold, tp, fp, tn, fn, round(rc, 4) AS recall, round(fr, 4) AS fpr, round(pr, 4) AS precision, "
              "round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 4) AS f1")


@check("a32_threshold_sweep", f"WITH {_SWEEP} SELECT {_SWEEP_OUT} FROM r")
def a32(spark, d):
    return E.threshold_sweep(cases(spark, d)).drop("_r", "_f")


@check("t05_best_threshold", f"WITH {_SWEEP} SELECT {_SWEEP_OUT} FROM r WHERE fr <= 0.25 ORDER BY rc DESC, fr, threshold LIMIT 1")
def t05(spark, d):
    return E.best_threshold(E.threshold_sweep(cases(spark, d)), 0.25)


@check("f09_fpr_budget", f"WITH {_SWEEP} SELECT threshold, fp, tn FROM r WHERE fr <= 0.25")
def f09(spark, d):
    return E.threshold_sweep(cases(spark, d)).filter("_f <= 0.25").select("threshold", "fp", "tn")


@check("a33_band_distribution", f"""WITH {_SQL_CASES}, b(lo, hi, level) AS (VALUES (0, 29, 'SAFE'), (30, 59, 'SUSPICIOUS'), (60, 79, 'HIGH_RISK'), (80, 100, 'CRITICAL'))
    SELECT lo, level, count(call_id) FILTER (is_scam) AS scam, count(call_id) FILTER (NOT is_scam) AS legitimate
    FROM b LEFT JOIN c ON risk_score BETWEEN lo AND hi GROUP BY lo, level""")
def a33(spark, d):
    return E.band_distribution(cases(spark, d), dimension(spark, "bands"))


@check("f08_failures", f"WITH {_SQL_CASES} SELECT call_id, gold_class, classification, risk_score FROM c WHERE is_scam <> (risk_score >= 60)")
def f08(spark, d):
    return E.failures(cases(spark, d)).select("call_id", "gold_class", "classification", "risk_score")


@check("t06_first_failures", f"WITH {_SQL_CASES} SELECT call_id FROM c WHERE is_scam <> (risk_score >= 60) ORDER BY call_id LIMIT 15")
def t06(spark, d):
    return E.failures(cases(spark, d)).select("call_id").orderBy("call_id").limit(15)


@check("a38_generation_check", f"""WITH {_SQL_CASES}, f AS (SELECT *, n_chars % 9 <> 0 AS valid FROM c ORDER BY call_id LIMIT 8)
    SELECT count(*) AS sampled, round(avg(valid::INT), 3) AS json_validity, round(avg((valid AND classification = gold_class)::INT), 3) AS classification_agreement FROM f""")
def a38(spark, d):
    return E.generation_check(cases(spark, d).selectExpr(
        "call_id AS ord", "n_chars % 9 <> 0 AS valid", "classification", "gold_class"))


@check("k06_report_rows", f"WITH {_SQL_CASES}, {_sql_metrics('c')}".replace("SELECT n, n_scam", "SELECT metric, value::DOUBLE AS value FROM (UNPIVOT (SELECT n::DOUBLE AS n, n_scam::DOUBLE AS n_scam", 1)
       .replace(", n_legitimate, round(", ", n_legitimate::DOUBLE AS n_legitimate, round(", 1) + ") ON COLUMNS(*) INTO NAME metric VALUE value)")
def k06(spark, d):
    return E.report_rows(E.decision_metrics(cases(spark, d)))


# --- dataset ---------------------------------------------------------------------------------

# Families are sources; a family's class comes from its number, every seventh source is held out.
_FAM = "CASE WHEN substr(source, 4)::INT % 5 < 3 THEN 'SCAM' ELSE 'SAFE' END"
_SQL_FAM = f"""fam AS (SELECT DISTINCT source AS family, {_FAM} AS class, substr(source, 4)::INT % 7 = 6 AS holdout FROM documents),
  pool AS (SELECT family, class, row_number() OVER (PARTITION BY class ORDER BY md5('20260809:' || family), family) - 1 AS i,
    count(*) OVER (PARTITION BY class) AS n FROM fam WHERE NOT holdout),
  quota AS (SELECT *, greatest(1, round_even(n * 0.15::DOUBLE, 0)::BIGINT) AS nv, greatest(1, round_even(n * 0.15::DOUBLE, 0)::BIGINT) AS nt FROM pool),
  fix AS (SELECT *, CASE WHEN n - nv - nt < 1 THEN greatest(1, n - 2) ELSE n - nv - nt END AS a, CASE WHEN n - nv - nt < 1 THEN least(1, n - 1) ELSE nv END AS b FROM quota),
  asg AS (SELECT family, class, CASE WHEN i < a THEN 'train' WHEN i < a + b THEN 'validation' ELSE 'test' END AS split FROM fix
    UNION ALL SELECT family, class, 'test' FROM fam WHERE holdout)"""


def families(spark, d):
    num = F.substring("source", 4, 9).cast("int")
    return table(spark, d, "documents").select("source").distinct().select(
        F.col("source").alias("family"), F.when(num % 5 < 3, "SCAM").otherwise("SAFE").alias("class"), (num % 7 == 6).alias("holdout"))


@check("x01_family_split", f"WITH {_SQL_FAM} SELECT family, class, split FROM asg")
def x01(spark, d):
    return D.split_families(families(spark, d))


def records(spark, d):
    docs = table(spark, d, "documents")
    num = F.substring("source", 4, 9).cast("int")
    rec = docs.select(
        F.col("doc_id").alias("call_id"), F.col("source").alias("family"), "lang", "n_chars",
        D.slices(F.col("lang"), F.when(F.col("n_chars") > 1500, "subtle").otherwise("legitimate"), num % 5 < 3,
                 F.col("n_chars") % 4 == 0, num % 7 == 6).alias("slices"))
    return D.assign_split(rec, D.split_families(families(spark, d)))


_SL = """list_filter([lang, CASE WHEN n_chars > 1500 THEN 'subtle' ELSE 'legitimate' END,
    CASE WHEN substr(source, 4)::INT % 5 < 3 THEN 'scam' ELSE CASE WHEN n_chars > 1500 THEN 'legitimate' END END,
    CASE WHEN n_chars % 4 = 0 THEN 'asr_noisy' END, CASE WHEN substr(source, 4)::INT % 7 = 6 THEN 'unseen_pattern' END], lambda x: x IS NOT NULL)"""
_SQL_REC = f"{_SQL_FAM}, rec AS (SELECT doc_id AS call_id, source AS family, lang, n_chars, {_SL} AS slices, split FROM documents JOIN asg ON family = source)"


@check("j10_record_split", f"WITH {_SQL_REC} SELECT call_id, family, split FROM rec")
def j10(spark, d):
    return records(spark, d).select("call_id", "family", "split")


@check("a37_slice_tags", f"WITH {_SQL_REC} SELECT call_id, array_to_string(slices, '|') AS slices FROM rec")
def a37(spark, d):
    return records(spark, d).select("call_id", F.array_join("slices", "|").alias("slices"))


@check("a06_split_and_slice_counts", f"""WITH {_SQL_REC} SELECT split, '' AS slice, count(*) AS n FROM rec GROUP BY split
    UNION ALL SELECT split, slice, count(*) FROM (SELECT split, unnest(slices) AS slice FROM rec) GROUP BY ALL""")
def a06(spark, d):
    rec = records(spark, d)
    return D.split_counts(rec).select("split", F.lit("").alias("slice"), "n").unionByName(D.slice_counts(rec))


@check("a07_families_per_split", f"WITH {_SQL_REC} SELECT DISTINCT split, family FROM rec")
def a07(spark, d):
    return D.split_families_listed(records(spark, d))


@check("a08_hard_negative_share", f"WITH {_SQL_FAM} SELECT round(avg((class <> 'SCAM')::INT), 4) AS share FROM fam")
def a08(spark, d):
    return D.hard_negative_share(families(spark, d))


# Leakage needs records whose family sits in two splits: here single records are split by length.
_LEAKY = "CASE WHEN n_chars % 3 = 0 THEN 'train' WHEN lang = 'en' THEN 'test' ELSE 'validation' END"


@check("j11_leakage", f"""WITH r AS (SELECT lang || n_chars % 50 AS family, {_LEAKY} AS split FROM documents)
    SELECT DISTINCT split, family FROM r WHERE split <> 'train' AND family IN (SELECT family FROM r WHERE split = 'train')""")
def j11(spark, d):
    return D.leakage(table(spark, d, "documents").selectExpr("concat(lang, n_chars % 50) AS family", f"{_LEAKY} AS split"))


@check("o03_family_intersect", f"""WITH r AS (SELECT lang || n_chars % 50 AS family, {_LEAKY} AS split FROM documents)
    SELECT family FROM r WHERE split = 'train' INTERSECT SELECT family FROM r WHERE split = 'test'""")
def o03(spark, d):
    r = table(spark, d, "documents").selectExpr("concat(lang, n_chars % 50) AS family", f"{_LEAKY} AS split")
    return r.filter("split = 'train'").select("family").intersect(r.filter("split = 'test'").select("family"))


@check("o01_union_sources", """SELECT doc_id AS call_id, source AS family, lang AS language_mode FROM documents
    UNION ALL SELECT page_id, 'real::' || page_id, NULL FROM pages""")
def o01(spark, d):
    made = table(spark, d, "documents").selectExpr("doc_id AS call_id", "source AS family", "lang AS language_mode")
    real = table(spark, d, "pages").selectExpr("page_id AS call_id", "concat('real::', page_id) AS family")
    return made.unionByName(real, allowMissingColumns=True)


@check("k03_slice_fan_out", f"WITH {_SQL_REC} SELECT slice, call_id FROM (SELECT call_id, split, unnest(slices) AS slice FROM rec) WHERE split = 'test'")
def k03(spark, d):
    return W.slice_rows(records(spark, d)).select("slice", "call_id")


@check("k05_manifest", f"""WITH {_SQL_REC} SELECT 'count' AS section, split, '' AS key, count(*) AS value FROM rec GROUP BY split
    UNION ALL SELECT 'slice', split, slice, count(*) FROM (SELECT split, unnest(slices) AS slice FROM rec) GROUP BY ALL
    UNION ALL SELECT DISTINCT 'family', split, family, 1 FROM rec""")
def k05(spark, d):
    return D.manifest(records(spark, d))


# --- gold roll-up: conversation turns carry an annotated category and a stage --------------------

_CATS = ("URGENCY", "FEAR", "OTP_REQUEST", "SECRECY", "MONEY_TRANSFER", "PERSONAL_DATA_REQUEST", "PROTECTIVE_ADVICE")
_CATSQL = "CASE length(text) % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATS)) + " END"
_STAGES = ("INTRODUCTION", "IDENTITY_CLAIM", "PROBLEM_CREATION", "EXIT", "UNKNOWN")
_STAGESQL = "CASE length(text) % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_STAGES)) + " END"
_GC = "CASE conv_id % 3 WHEN 0 THEN 'SAFE' ELSE 'SCAM' END"
_GT = "CASE WHEN conv_id % 4 = 1 THEN 'BANK_IMPERSONATION' ELSE 'OTP_THEFT' END"
_SPK = "CASE role WHEN 'user' THEN 'VICTIM' WHEN 'assistant' THEN 'CALLER' ELSE 'UNKNOWN' END"


def _list_map(mapping: dict) -> str:
    return f"list_filter(list_transform(cats, lambda c: {sql_case('c', mapping)}), lambda t: t IS NOT NULL)"


@check("a36_gold_rollup", f"""WITH t AS (SELECT conv_id AS call_id, turn AS seq, {_SPK} AS speaker, {_CATSQL} AS category, {_STAGESQL} AS stage, {_GC} AS gold_class,
      CASE WHEN conv_id % 5 < 2 THEN 'obvious' ELSE 'subtle' END AS difficulty, conv_id % 2 = 0 AS noisy, {_GT} AS scam_type FROM conversations),
    f AS (SELECT call_id, category, min(seq) AS seq FROM t WHERE category IS NOT NULL GROUP BY ALL),
    l AS (SELECT call_id, list(category ORDER BY seq) AS cats0 FROM f GROUP BY call_id),
    g AS (SELECT call_id, any_value(gold_class) AS gold_class, any_value(difficulty) AS difficulty, any_value(noisy) AS noisy, any_value(scam_type) AS scam_type,
      arg_max(stage, {sql_case('stage', v.STAGE_DEPTH)}) AS stage, min(seq) FILTER (stage = 'IDENTITY_CLAIM' AND speaker = 'CALLER') AS identity_seq FROM t GROUP BY call_id),
    j AS (SELECT g.*, list_concat(coalesce(cats0, []), CASE WHEN gold_class = 'SCAM' AND identity_seq IS NOT NULL THEN ['IMPERSONATION'] ELSE [] END) AS cats FROM g LEFT JOIN l USING (call_id)),
    k AS (SELECT *, {_list_map(v.CATEGORY_TACTIC)} AS tac, {_list_map(ACTION_TEXT)} AS act FROM j)
    SELECT call_id, gold_class, round(CASE WHEN gold_class <> 'SCAM' THEN 0.88 WHEN difficulty = 'obvious' THEN 0.90 ELSE 0.74 END - CASE WHEN noisy THEN 0.08 ELSE 0 END, 2)::DOUBLE AS confidence,
      array_to_string(cats, '|') AS categories, array_to_string(list_concat(list_filter(tac, lambda x, i: list_position(tac, x) = i),
      CASE WHEN scam_type = 'BANK_IMPERSONATION' THEN ['AUTHORITY'] ELSE [] END), '|') AS tactics,
      array_to_string(list_filter(act, lambda x, i: list_position(act, x) = i), '|') AS requested_actions, stage FROM k""")
def a36(spark, d):
    t = table(spark, d, "conversations").selectExpr(
        "conv_id AS call_id", "turn AS seq", f"{_SPK} AS speaker", f"{_CATSQL} AS category", f"{_STAGESQL} AS stage",
        f"{_GC} AS gold_class", "IF(conv_id % 5 < 2, 'obvious', 'subtle') AS difficulty", "conv_id % 2 = 0 AS noisy",
        f"array({_GT}) AS scam_types")
    calls = t.select("call_id", "gold_class", "difficulty", "noisy", "scam_types").distinct()
    notes = t.filter("category IS NOT NULL").selectExpr("call_id", "seq", "0 AS ord", "category")
    out = D.gold_rollup(notes, t.select("call_id", "seq", "speaker", "stage"), calls)
    join = lambda c: F.array_join(c, "|").alias(c)
    return out.select("call_id", "gold_class", "confidence", join("categories"), join("tactics"), join("requested_actions"), "stage")


@check("j13_annotation_evidence", f"""SELECT conv_id AS call_id, turn AS seq, {_CATSQL} AS category, md5(trim(text)) AS evidence
    FROM conversations WHERE {_CATSQL} IS NOT NULL""")
def j13(spark, d):
    from checks.common import segments

    notes = table(spark, d, "conversations").selectExpr(
        "conv_id AS call_id", "turn AS seq", "0 AS ord", f"{_CATSQL} AS category", "'HIGH' AS severity").filter("category IS NOT NULL")
    return D.annotated_events(notes, segments(spark, d)).select(
        "call_id", "seq", "category", F.md5(F.col("evidence").cast("binary")).alias("evidence"))


@check("f10_supervised_examples", """WITH t AS (SELECT doc_id, string_split(text, ' ')[1:(doc_id % 7 + 1)::INT] AS p, string_split(text, ' ') AS f FROM documents)
    SELECT doc_id, len(f)::INT AS n, least(len(p), len(f))::INT AS masked FROM t WHERE len(f) <= 300""")
def f10(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.transform(F.split("text", " "), F.length).alias("full_ids")).withColumn(
        "prompt_ids", F.slice("full_ids", F.lit(1), (F.col("doc_id") % 7 + 1).cast("int")))
    return D.supervised_examples(t, 300).select(
        "doc_id", F.size("full_ids").alias("n"), F.size(F.filter("labels", lambda x: x == -100)).alias("masked"))


@check("x02_dataset_records", f"""WITH {SQL_SEGMENTS}, c0 AS (SELECT conv_id AS call_id, turn AS seq, {_CATSQL} AS category, {_GC} AS gc FROM conversations),
    ev AS (SELECT c0.call_id, c0.seq, category, start, text FROM c0 JOIN seg USING (call_id, seq) WHERE category IS NOT NULL),
    g AS (SELECT call_id, any_value(gc) AS gc FROM c0 GROUP BY 1),
    idn AS (SELECT call_id, min(seq) AS seq FROM seg JOIN g USING (call_id) WHERE speaker = 'CALLER' AND gc = 'SCAM' GROUP BY 1),
    f AS (SELECT call_id, 1 AS k, seq, category, start, text FROM ev
      UNION ALL SELECT call_id, 0, seq, 'IMPERSONATION', start, text FROM seg JOIN idn USING (call_id, seq)),
    fl AS (SELECT call_id, count(*) AS n, string_agg(category || '@' || {sql_ts('start')} || '@' || text, chr(10) ORDER BY k, seq) AS l FROM f GROUP BY 1),
    sl AS (SELECT call_id, count(*) AS n, string_agg({sql_ts('start')} || '|' || speaker || '|' || text, chr(10) ORDER BY seq) AS l FROM seg GROUP BY 1)
    SELECT call_id, sl.n::INT AS n_segments, md5(sl.l) AS transcript, gc AS gold_class, coalesce(fl.n, 0)::INT AS n_factors,
      md5(coalesce(fl.l, '')) AS factors, 3 AS n_messages, gc AS answered FROM sl JOIN g USING (call_id) LEFT JOIN fl USING (call_id)""")
def x02(spark, d):
    records = _records(spark, d)
    line = lambda s: F.concat_ws("|", s["timestamp"], s["speaker"], s["text"])
    factor = lambda f: F.concat_ws("@", f["category"], f["timestamp"], f["evidence"])
    md5 = lambda c, of: F.md5(F.array_join(F.transform(c, of), "\n").cast("binary"))
    return records.select(
        "call_id", F.size("segments").alias("n_segments"), md5("segments", line).alias("transcript"),
        F.col("gold.classification").alias("gold_class"), F.size("gold.risk_factors").alias("n_factors"),
        md5("gold.risk_factors", factor).alias("factors"), F.size("messages").alias("n_messages"),
        F.get_json_object(F.element_at("messages", 3)["content"], "$.classification").alias("answered"))


def _records(spark, d):
    from callward.operators import segments as S
    from callward.operators.verdict import call_facts
    from checks.common import segments

    seg, conv = segments(spark, d), table(spark, d, "conversations")
    facts = call_facts(seg)
    notes = conv.selectExpr("conv_id AS call_id", "turn AS seq", "0 AS ord", f"{_CATSQL} AS category", "'HIGH' AS severity").filter("category IS NOT NULL")
    gold = conv.groupBy("conv_id").agg(F.expr(f"any_value({_GC})").alias("gold_class")).withColumnRenamed("conv_id", "call_id") \
        .withColumn("confidence", F.lit(0.9)).join(
            seg.groupBy("call_id").agg(F.min(F.when(F.col("speaker") == "CALLER", F.col("seq"))).alias("identity_seq")), "call_id")
    prompts = S.prompts(seg, facts, facts.select("call_id", F.lit("unknown").alias("dominant")))
    calls = facts.select("call_id", "call_direction", F.lit("f").alias("family"), F.lit("f").alias("family_label"),
                         F.lit("mixed").alias("language_mode"), F.lit(False).alias("asr_noisy"))
    return D.build_records(seg, calls, gold, prompts, D.gold_factors(D.annotated_events(notes, seg), gold, seg))


@check("k04_replay_round_trip", f"""WITH {SQL_SEGMENTS}, g AS (SELECT conv_id AS call_id, any_value({_GC}) AS gc FROM conversations GROUP BY 1)
    SELECT call_id::VARCHAR AS call_id, any_value(gc) AS expected, count(*) AS n, md5(string_agg(speaker || '|' || text, chr(10) ORDER BY seq)) AS lines
    FROM seg JOIN g USING (call_id) GROUP BY 1""")
def k04(spark, d):
    """Records written as replay files and read back as calls and turns."""
    from callward.operators.cut import scratch
    from callward.sources import readers as R

    path = scratch(spark, "replay") + "/calls"
    W.replay(_records(spark, d), path)
    calls = spark.read.schema(R.REPLAY).json(path)
    turns = R.turns_of(calls).groupBy("call_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("turn", F.concat_ws("|", "speaker", "text").alias("l")))), lambda x: x["l"]), "\n").cast("binary")).alias("lines"))
    return calls.select("call_id", F.col("expected_classification").alias("expected")).join(turns, "call_id")


@check("k01_jsonl", """SELECT doc_id, md5(text) AS text, count(*) OVER () AS written FROM documents""")
def k01(spark, d):
    """Whole texts written as JSON lines, with the count taken while writing, and read back."""
    from callward.operators.cut import scratch

    path = scratch(spark, "jsonl") + "/rows"
    n = W.jsonl(table(spark, d, "documents").select("doc_id", "text"), path)
    return spark.read.schema("doc_id bigint, text string").json(path).select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text"), F.lit(n).cast("bigint").alias("written"))


@check("k02_by_split", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM documents""")
def k02(spark, d):
    """Rows written by split and read back folder by folder."""
    from callward.operators.cut import scratch

    path = scratch(spark, "splits") + "/rows"
    split = F.expr("CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END")
    W.by_split(table(spark, d, "documents").select("doc_id", split.alias("split")), path)
    parts = [spark.read.schema("doc_id bigint").json(f"{path}/split={x}").select("doc_id", F.lit(x).alias("split")) for x in D.SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("s02_corpus_lines", """SELECT conv_id AS call_id, count(*) AS n, count(*) FILTER ((conv_id + turn) % 7 = 0) AS rejected FROM conversations GROUP BY 1""")
def s02(spark, d):
    """JSON lines of which every seventh is cut off: they are kept aside with their text."""
    from callward.operators.cut import scratch
    from callward.sources import readers as R

    path = scratch(spark, "corpus") + "/lines"
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("call_id"), F.col("role").alias("family")))
    rows = table(spark, d, "conversations").withColumn("l", line).selectExpr("IF((conv_id + turn) % 7 = 0, substr(l, 1, length(l) - 3), l) AS value")
    rows.write.text(path)
    found = R.corpus_lines(spark, path)
    key = F.regexp_extract(F.coalesce("rejected", F.concat(F.lit('{"call_id":"'), F.col("call_id"), F.lit('"'))), '"call_id":"([0-9]+)"', 1)
    return found.groupBy(key.cast("bigint").alias("call_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("rejected").isNotNull()).alias("rejected"))


