"""Checks of the sequence rules, verdicts and scores (conversations as calls)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callward import vocab as v
from callward.operators import concepts, lexicon_table, score, sequence, verdict
from callward.operators import store as ST
from callward.operators.cut import materialize
from callward.params import Lexicon, dimension
from callward.plans import batch
from checks import analysis_sql as A
from checks.common import (CONJUNCTIONS, MARKERS, PROSE, SQL_CLAUSES, SQL_LEX, b, check, segments, sql_case, sql_in,
                           sql_ts)


def clauses(spark: SparkSession, d: str) -> DataFrame:
    return concepts.clauses(segments(spark, d), PROSE, MARKERS, CONJUNCTIONS)


def context(spark: SparkSession, d: str) -> DataFrame:
    # the marks and the join read the signals six times, and patterns are costly
    sig = materialize(sequence.signals(clauses(spark, d)).drop("padded"), "signals")
    return sequence.in_context(sig, sequence.context_marks(sig))


def analysis(spark: SparkSession, d: str) -> batch.Analysis:
    return batch.analyze(segments(spark, d), PROSE, MARKERS, CONJUNCTIONS)


def scored(spark: SparkSession, d: str) -> batch.Scored:
    return batch.score_calls(analysis(spark, d))


def joined(column: str):
    return F.array_join(column, "|").alias(column)


# --- concepts, acts, context -----------------------------------------------------

@check("p15_clauses", f"WITH {SQL_CLAUSES} SELECT call_id, seq, clause_ix, evidence FROM clause")
def p15(spark, d):
    return clauses(spark, d).select("call_id", "seq", F.col("clause_ix").cast("bigint").alias("clause_ix"), "evidence")


@check("p16_speech_act", f"WITH {SQL_CLAUSES} SELECT speaker, act, count(*) AS n FROM clause GROUP BY ALL")
def p16(spark, d):
    return clauses(spark, d).groupBy("speaker", "act").agg(F.count("*").alias("n"))


@check("j01_concept_match", f"""WITH {SQL_CLAUSES}
    SELECT h.call_id, h.seq, h.clause_ix, h.concept, arg_min(h.stem, h.ord) AS stem
    FROM hit h JOIN clause c USING (call_id, seq, clause_ix) JOIN (SELECT DISTINCT concept, bit FROM lex) l ON l.concept = h.concept
    WHERE (c.mask & l.bit) <> 0 GROUP BY ALL""")
def j01(spark, d):
    return concepts.matched_stems(clauses(spark, d), PROSE).select(
        "call_id", "seq", F.col("clause_ix").cast("bigint").alias("clause_ix"), "concept", "stem")


@check("j01_lexicon_table", f"""WITH {SQL_CLAUSES}
    SELECT c.call_id, c.seq, c.clause_ix, c.mask::BIGINT AS mask, {b('TARGET_OTP', col='prior')} AS prior_otp, {b(*v.CREDENTIAL_TARGETS, col='prior')} AS prior_cred,
      {b('NEVER_ASKS', col='prior')} AS prior_never, coalesce(string_agg(s.concept || ':' || s.stem, '|' ORDER BY s.concept), '') AS stems
    FROM clause c LEFT JOIN (SELECT h.call_id, h.seq, h.clause_ix, h.concept, h.bit, arg_min(h.stem, h.ord) AS stem FROM hit h GROUP BY ALL) s
      ON s.call_id = c.call_id AND s.seq = c.seq AND s.clause_ix = c.clause_ix AND (c.mask & s.bit) <> 0 GROUP BY ALL""")
def j01t(spark, d):
    """Concept sets and stems through a lexicon that stays a table."""
    lexicon = PROSE.to_df(spark)
    plain = concepts.clauses(segments(spark, d), Lexicon((), PROSE.otp_password_phrase), MARKERS, CONJUNCTIONS)
    found = lexicon_table.matches(plain, lexicon)
    rows = lexicon_table.clauses(segments(spark, d), lexicon, MARKERS, CONJUNCTIONS, PROSE.otp_password_phrase, found)
    listed = lexicon_table.matched_stems(rows, found).groupBy("call_id", "seq", "clause_ix").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("concept", F.lit(":"), "stem"))), "|").alias("stems"))
    return rows.join(listed, ["call_id", "seq", "clause_ix"], "left").select(
        "call_id", "seq", F.col("clause_ix").cast("bigint").alias("clause_ix"), "mask", "prior_otp", "prior_cred", "prior_never", F.coalesce("stems", F.lit("")).alias("stems"))


@check("j02_overlaps", f"""WITH {SQL_CLAUSES} SELECT call_id, seq, clause_ix, mask::BIGINT AS mask FROM clause
    WHERE {b('TARGET_OTP')} OR {b('TARGET_CARD_FULL')}""")
def j02(spark, d):
    return clauses(spark, d).filter(f"{concepts.sql_has('mask', 'TARGET_OTP', 'TARGET_CARD_FULL')}").select(
        "call_id", "seq", F.col("clause_ix").cast("bigint").alias("clause_ix"), "mask")


@check("w03_prior_concepts", f"""WITH {SQL_CLAUSES} SELECT call_id, seq, clause_ix,
    {b('TARGET_OTP', col='prior')} AS prior_otp, {b(*v.CREDENTIAL_TARGETS, col='prior')} AS prior_cred,
    {b('NEVER_ASKS', col='prior')} AS prior_never FROM clause""")
def w03(spark, d):
    return clauses(spark, d).select("call_id", "seq", F.col("clause_ix").cast("bigint").alias("clause_ix"),
                                    "prior_otp", "prior_cred", "prior_never")


KEPT = f"(mask <> 0 OR clause_ix = 0 OR (forbids AND scope) OR (asks AND {b('TARGET_OTP', col='prior')}))"


@check("w04_running_context", A.with_context(f"""SELECT call_id, seq, clause_ix, cp <> 0 AS problem_known, dm AS demanded,
    an AS announced, active, problems::BIGINT AS problems FROM ctx WHERE {KEPT}"""))
def w04(spark, d):
    return context(spark, d).select("call_id", "seq", F.col("clause_ix").cast("bigint").alias("clause_ix"),
                                    "problem_known", "demanded", "announced", "active", "problems")


@check("o04_caller_problems", A.with_context(
    "SELECT call_id, bit_or(problems)::BIGINT AS caller_problems FROM ctx GROUP BY call_id HAVING bit_or(problems) <> 0"))
def o04(spark, d):
    return sequence.call_context(context(spark, d)).filter("caller_problems <> 0").select("call_id", "caller_problems")


@check("w05_first_observations", A.with_verdict("""SELECT k.call_id, u.kind, c.seq, c.evidence FROM (
    UNPIVOT (SELECT call_id, identity_k AS identity, problem_k AS problem, solution_k AS solution, reward_k AS reward,
      protective_k AS protective, compliance_k AS compliance, doubt_k AS doubt, inquiry_k AS inquiry FROM kinds)
    ON identity, problem, solution, reward, protective, compliance, doubt, inquiry INTO NAME kind VALUE kk) u
    JOIN kinds k USING (call_id) JOIN ctx c ON c.call_id = u.call_id AND c.k = u.kk"""))
def w05(spark, d):
    return sequence.first_observations(context(spark, d)).select("call_id", "kind", "seq", "evidence")


@check("r01_protective_clauses", A.with_context(
    "SELECT call_id, seq, clause_ix, speaker, protective::INT AS protective FROM ctx WHERE protective > 0"))
def r01(spark, d):
    return context(spark, d).filter("protective > 0").select(
        "call_id", "seq", F.col("clause_ix").cast("bigint").alias("clause_ix"), "speaker", "protective")


def _rule_check(name: str, categories: tuple[str, ...]):
    @check(name, A.with_events(
        f"SELECT call_id, seq, k, rule, category, severity FROM (SELECT call_id, seq, rule, category, severity, "
        f"row_number() OVER (PARTITION BY call_id, seq, rule ORDER BY k) AS k FROM ev0) WHERE category IN {sql_in(categories)}"))
    def run(spark, d):
        from pyspark.sql import Window

        ev = sequence.clause_events(context(spark, d)).filter(F.col("category").isin(*categories))
        k = F.row_number().over(Window.partitionBy("call_id", "seq", "rule").orderBy("pos"))
        return ev.select("call_id", "seq", k.cast("bigint").alias("k"), "rule", "category", "severity")
    return run


_rule_check("r02_otp_requests", ("OTP_REQUEST",))
_rule_check("r03_credential_requests", ("CARD_REQUEST", "PASSWORD_REQUEST", "PERSONAL_DATA_REQUEST"))
_rule_check("r04_money_movement", v.MONEY)
_rule_check("r05_device_access", v.DEVICE)
_rule_check("r06_pressure", ("THREAT", "FEAR", "URGENCY", "SECRECY", "ISOLATION"))


@check("r07_caller_observations", A.with_context(f"""SELECT call_id,
    count(*) FILTER ({A._KINDS['identity']}) AS identity, count(*) FILTER ({A._KINDS['problem']}) AS problem,
    count(*) FILTER ({A._KINDS['solution']}) AS solution, count(*) FILTER ({A._KINDS['reward']}) AS reward
    FROM ctx WHERE {KEPT} GROUP BY call_id"""))
def r07(spark, d):
    return context(spark, d).groupBy("call_id").agg(*[
        F.expr(f"count_if({sequence.OBSERVATIONS[k]})").alias(k) for k in ("identity", "problem", "solution", "reward")])


@check("r08_victim_context", A.with_context(f"""SELECT call_id,
    count(*) FILTER ({A._KINDS['compliance']}) AS compliance, count(*) FILTER ({A._KINDS['doubt']}) AS doubt,
    count(*) FILTER ({A._KINDS['inquiry']}) AS inquiry,
    coalesce(sum(protective) FILTER (speaker = 'VICTIM'), 0)::BIGINT AS protective
    FROM ctx WHERE {KEPT} GROUP BY call_id"""))
def r08(spark, d):
    return context(spark, d).groupBy("call_id").agg(
        *[F.expr(f"count_if({sequence.OBSERVATIONS[k]})").alias(k) for k in ("compliance", "doubt", "inquiry")],
        F.expr("coalesce(sum(IF(speaker = 'VICTIM', protective, NULL)), 0L)").alias("protective"))


@check("r09_unknown_speaker", A.with_context(f"""SELECT call_id, sum(protective)::BIGINT AS protective,
    count(*) FILTER (active) AS acting FROM ctx WHERE speaker = 'UNKNOWN' AND {KEPT} GROUP BY call_id"""))
def r09(spark, d):
    return context(spark, d).filter("speaker = 'UNKNOWN'").groupBy("call_id").agg(
        F.sum("protective").alias("protective"), F.expr("count_if(active)").alias("acting"))


# --- events and verdicts -----------------------------------------------------------

@check("a05_event_dedupe", A.with_events("SELECT call_id, category, sec, severity, rule, evidence FROM ev"))
def a05(spark, d):
    return verdict.dedupe_events(sequence.clause_events(context(spark, d))).select(
        "call_id", "category", "sec", "severity", "rule", "evidence")


@check("a20_verdict", A.with_verdict("""SELECT call_id, l_identity, l_problem, l_pressure, l_solution, payoff,
    n_pressure::INT AS n_pressure, classification FROM verdict"""))
def a20(spark, d):
    return analysis(spark, d).summary.select(
        "call_id", "l_identity", "l_problem", "l_pressure", "l_solution", "payoff",
        F.col("n_pressure").cast("int").alias("n_pressure"), "classification")


@check("a21_confidence", A.with_verdict(
    "SELECT call_id, classification, n_links::INT AS n_links, n_critical, n_events::BIGINT AS n_events, confidence FROM verdict"))
def a21(spark, d):
    return analysis(spark, d).summary.select(
        "call_id", "classification", F.col("n_links").cast("int").alias("n_links"), "n_critical",
        F.col("n_events").cast("bigint").alias("n_events"), "confidence")


@check("a22_scam_types", A.with_verdict("SELECT call_id, array_to_string(scam_types, '|') AS scam_types FROM verdict"))
def a22(spark, d):
    return analysis(spark, d).summary.select("call_id", joined("scam_types"))


@check("a23_tactics", A.with_verdict("SELECT call_id, array_to_string(tactics, '|') AS tactics FROM verdict"))
def a23(spark, d):
    return analysis(spark, d).summary.select("call_id", joined("tactics"))


@check("a24_stage", A.with_verdict("SELECT call_id, stage FROM verdict"))
def a24(spark, d):
    return analysis(spark, d).summary.select("call_id", "stage")


@check("a25_requested_actions", A.with_verdict(
    "SELECT call_id, array_to_string(requested_actions, '|') AS requested_actions FROM verdict"))
def a25(spark, d):
    return analysis(spark, d).summary.select("call_id", joined("requested_actions"))


@check("a26_framing_events", A.with_verdict("SELECT call_id, seq, category, severity, evidence FROM framing"))
def a26(spark, d):
    a = analysis(spark, d)
    return verdict.framing_events(a.observations, a.summary).select("call_id", "seq", "category", "severity", "evidence")


@check("a27_protective_rows", A.with_verdict("SELECT call_id, seq, sec, evidence FROM prot"))
def a27(spark, d):
    a = analysis(spark, d)
    return verdict.protective_events(sequence.protective_rows(a.context), a.summary).select(
        "call_id", "seq", "sec", "evidence")


@check("st06_realtime_hold", A.with_verdict(
    "SELECT call_id, payoff, CASE WHEN payoff THEN 'SUSPICIOUS' ELSE 'SAFE' END AS classification FROM s7 WHERE call_id % 2 = 0"))
def st06(spark, d):
    """The live rule where it holds: every second call is given a solution as its only framing.

    No call is framed so by itself, as a solution event needs a problem event.
    """
    alone = {"l_identity": F.lit(False), "l_problem": F.lit(False), "l_solution": F.col("call_id") % 2 == 0, "l_pressure": F.lit(False), "n_pressure": F.lit(0)}
    framed = analysis(spark, d).summary.withColumns(alone).withColumn("classification", F.expr(verdict.classify(True)))
    return framed.filter(verdict.REALTIME_HOLD).select("call_id", "payoff", "classification")


@check("f04_grounded_only", A.with_score("SELECT call_id, count(*) AS n FROM part WHERE trim(evidence) <> '' GROUP BY call_id"))
def f04(spark, d):
    ev = analysis(spark, d).events
    return ev.filter((F.col("segment_index").isNotNull()) & (F.trim("evidence") != "")).groupBy("call_id").agg(
        F.count("*").alias("n"))


@check("f05_score_eligibility", A.with_score(
    "SELECT coalesce(rejected, 'scored') AS outcome, category, count(*) AS n FROM part GROUP BY ALL"))
def f05(spark, d):
    return scored(spark, d).partitioned.groupBy(F.coalesce("rejected", F.lit("scored")).alias("outcome"), "category").agg(
        F.count("*").alias("n"))


@check("f06_category_predicates", A.with_score(f"""SELECT call_id, count(*) FILTER (category IN {sql_in(v.HARMFUL)}) AS harmful,
    count(*) FILTER (category IN {sql_in(v.PRESSURE)}) AS pressure,
    count(*) FILTER (category IN {sql_in(v.HARMFUL)} AND severity = 'CRITICAL') AS critical FROM events GROUP BY call_id"""))
def f06(spark, d):
    dims = F.broadcast(dimension(spark, "category_map").select("category", "harmful", "pressure"))
    return analysis(spark, d).events.join(dims, "category").groupBy("call_id").agg(
        F.count_if("harmful").alias("harmful"), F.count_if("pressure").alias("pressure"),
        F.count_if(F.col("harmful") & (F.col("severity") == "CRITICAL")).alias("critical"))


# --- score -----------------------------------------------------------------------------

@check("j05_rule_lookup", A.with_score(f"""SELECT call_id, seq, sec, category, severity, round(pts, 6) AS pts, grp,
    {sql_case('category', v.CATEGORY_STAGE)} AS stage, {sql_case('category', v.CATEGORY_TACTIC)} AS tactic FROM part"""))
def j05(spark, d):
    ev = analysis(spark, d).events
    rules, sev, cmap = (F.broadcast(dimension(spark, n)) for n in ("rules", "severity", "category_map"))
    return (ev.join(rules, "category", "left").join(sev, "severity", "left").join(cmap, "category", "left")
            .select("call_id", "seq", "sec", "category", "severity",
                    F.round(F.col("weight") * F.col("multiplier"), 6).alias("pts"), "grp", "stage", "tactic"))


GROUPS = tuple(v.GROUPS)


def _per_group(df: DataFrame, raw: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(g).alias("grp"), F.expr(raw.format(g=g, cap=v.GROUP_CAPS[g])).alias("value"),
                               F.col(f"raw_{g}").alias("_raw")) for g in GROUPS])
    return df.select("call_id", F.inline(pairs)).filter("_raw > 0").drop("_raw")


@check("a09_group_totals", A.with_score("SELECT call_id, grp, round(raw, 6) AS value FROM grp WHERE raw > 0"))
def a09(spark, d):
    return _per_group(scored(spark, d).assessed, "round(raw_{g}, 6)")


@check("a10_group_caps", A.with_score(
    f"SELECT call_id, grp, round(capped, 6) AS value, round(least(0, capped - raw), 6) AS adjustment FROM grp WHERE raw > 0"))
def a10(spark, d):
    df = _per_group(scored(spark, d).assessed, "named_struct('value', round(least(raw_{g}, {cap}D), 6),"
                    " 'adjustment', round(least(0D, {cap}D - raw_{g}), 6))")
    return df.select("call_id", "grp", "value.value", "value.adjustment")


@check("j06_interactions", A.with_score("SELECT call_id, label, points FROM inter"))
def j06(spark, d):
    terms = {k: c for k, c in score.components().items() if " + " in k}
    rows = ", ".join(f"named_struct('label', '{k}', 'points', {c})" for k, c in terms.items())
    return scored(spark, d).assessed.select("call_id", F.expr(f"inline(array({rows}))")).filter("points > 0")


@check("a11_soft_sum", A.with_score("SELECT call_id, round(soft, 6) AS soft FROM assessed"))
def a11(spark, d):
    return scored(spark, d).assessed.select("call_id", F.round("soft", 6).alias("soft"))


@check("a12_verdict_points", A.with_score("""SELECT call_id, CASE WHEN n_scored > 0 AND confidence >= 0.6 THEN
    CASE classification WHEN 'SCAM' THEN 12.0::DOUBLE WHEN 'SUSPICIOUS' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END
    ELSE 0.0::DOUBLE END AS points FROM assessed"""))
def a12(spark, d):
    return scored(spark, d).assessed.selectExpr("call_id", f"{score.components()['verdict']} AS points")


@check("a13_dampening", A.with_score(
    "SELECT call_id, round(mean_confidence, 6) AS mean_confidence, round(dampening, 6) AS dampening FROM assessed"))
def a13(spark, d):
    return scored(spark, d).assessed.select(
        "call_id", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("dampening", 6).alias("dampening"))


@check("a14_mitigations", A.with_score("SELECT call_id, call_direction, mit_protective, mit_inbound FROM assessed"))
def a14(spark, d):
    return scored(spark, d).assessed.select("call_id", "call_direction", "mit_protective", "mit_inbound")


@check("a15_policy_floor", A.with_score("SELECT call_id, floor FROM assessed"))
def a15(spark, d):
    return scored(spark, d).assessed.select("call_id", "floor")


@check("a16_risk_score", A.with_score("SELECT call_id, classification, risk_score, risk_level FROM assessed"))
def a16(spark, d):
    return scored(spark, d).assessed.select("call_id", "classification", "risk_score", "risk_level")


@check("j07_score_band", A.with_score("SELECT call_id, risk_score, risk_level AS level FROM assessed"))
def j07(spark, d):
    bands = F.broadcast(dimension(spark, "bands"))
    return scored(spark, d).assessed.select("call_id", "risk_score").join(
        bands, F.col("risk_score").between(F.col("lo"), F.col("hi"))).select("call_id", "risk_score", "level")


LEDGER_SQL = A.SQL_SCORE + f""",
led AS (
  SELECT call_id, CASE WHEN rejected IS NULL THEN 'event' ELSE 'mitigation' END AS kind,
    CASE WHEN rejected IS NULL THEN category || ' (' || severity || ')' ELSE category || ' not scored' END AS label,
    CASE WHEN rejected IS NULL THEN round_even(pts, 1) ELSE 0 END AS points, evidence, {sql_ts('sec')} AS timestamp
  FROM part WHERE (rejected IS NULL AND pts > 0) OR rejected = 'not caller'
  UNION ALL SELECT call_id, 'group_cap', grp || ' capped', round_even(capped - raw, 1), '', '' FROM grp WHERE raw > capped
  UNION ALL SELECT call_id, 'interaction', label, points, '', '' FROM inter
  UNION ALL SELECT call_id, 'event', 'model verdict ' || classification, CASE classification WHEN 'SCAM' THEN 12 ELSE 5 END, '', ''
    FROM assessed WHERE n_scored > 0 AND confidence >= 0.6 AND classification <> 'SAFE'
  UNION ALL SELECT call_id, 'dampening', 'low ASR confidence', round_even(dampening, 1), '', '' FROM assessed WHERE dampening < 0
  UNION ALL SELECT call_id, 'mitigation', 'protective advice present', mit_protective, '', '' FROM assessed WHERE mit_protective < 0
  UNION ALL SELECT call_id, 'mitigation', 'customer-initiated call', mit_inbound, '', '' FROM assessed WHERE mit_inbound < 0
  UNION ALL SELECT call_id, 'floor', 'policy floor ' || floor, round_even(floor - clamped, 1), '', '' FROM assessed WHERE floor > clamped)
"""


@check("a17_ledger", f"WITH RECURSIVE {LEDGER_SQL} SELECT call_id, kind, label, points::DOUBLE AS points, evidence, timestamp FROM led")
def a17(spark, d):
    s = scored(spark, d)
    return score.ledger(s.assessed, s.partitioned).select("call_id", "kind", "label", "points", "evidence", "timestamp")


@check("t02_top_contributions", f"""WITH RECURSIVE {LEDGER_SQL} SELECT call_id, rank, abs(points)::DOUBLE AS size FROM (
    SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY abs(points) DESC) AS rank FROM led) WHERE rank <= 6""")
def t02(spark, d):
    s = scored(spark, d)
    return score.top_contributions(score.ledger(s.assessed, s.partitioned)).select(
        "call_id", F.col("rank").cast("bigint").alias("rank"), F.abs("points").alias("size"))


@check("t08_points_in_group", A.with_score("""SELECT call_id, grp, row_number() OVER (PARTITION BY call_id, grp
    ORDER BY pts DESC, sec, category) AS ord, category, round(pts, 6) AS pts FROM part WHERE rejected IS NULL AND pts > 0"""))
def t08(spark, d):
    from pyspark.sql import Window

    rows = scored(spark, d).partitioned.filter("rejected IS NULL").selectExpr(
        "call_id", "category", "sec", f"{score.points()} AS p", f"{score.group_of()} AS grp").filter("p > 0")
    # groups of a call are ranked by (second, category), unique after event dedupe
    order = Window.partitionBy("call_id", "grp").orderBy(F.col("p").desc(), "sec", "category")
    return rows.select("call_id", "grp", F.row_number().over(order).cast("bigint").alias("ord"), "category",
                       F.round("p", 6).alias("pts"))


@check("a18_alert", A.with_score(f"""SELECT a.call_id, alert_level AS level, coalesce(c.category, 'risk_score') AS triggered_by,
    CASE WHEN c.sec IS NULL THEN '' ELSE {sql_ts('c.sec')} END AS timestamp, risk_score FROM assessed a LEFT JOIN (
      SELECT call_id, category, sec FROM part WHERE rejected IS NULL AND category IN {sql_in(v.HARMFUL)} AND severity = 'CRITICAL'
      QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY sec, category) = 1) c USING (call_id)"""))
def a18(spark, d):
    s = scored(spark, d)
    return score.alerts(s.assessed, s.partitioned).drop("headline", "detail", "guidance")


@check("j05_guidance", A.with_score(f"""SELECT a.call_id, CASE WHEN c.category IS NOT NULL THEN {sql_case('c.category', verdict.GUIDANCE, "''")}
      ELSE {sql_case('alert_level', verdict.GUIDANCE, "''")} END AS guidance,
    CASE WHEN c.category IS NOT NULL THEN true ELSE false END AS quoted FROM assessed a LEFT JOIN (
      SELECT call_id, category FROM part WHERE rejected IS NULL AND category IN {sql_in(v.HARMFUL)} AND severity = 'CRITICAL'
      QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY sec, category) = 1) c USING (call_id)"""))
def j05(spark, d):
    s = scored(spark, d)
    return score.alerts(s.assessed, s.partitioned).select("call_id", "guidance", F.col("detail").startswith("said: ").alias("quoted"))


@check("a19_disagreement", A.with_score("SELECT call_id, disagreement FROM assessed"))
def a19(spark, d):
    return scored(spark, d).assessed.select("call_id", "disagreement")


@check("a35_strongest_factor", A.with_score(f"""SELECT call_id, category, severity, sec FROM events
    QUALIFY row_number() OVER (PARTITION BY call_id, category ORDER BY {sql_case('severity', A._SEV)} DESC, sec) = 1"""))
def a35(spark, d):
    return score.strongest_per_category(analysis(spark, d).events).select("call_id", "category", "severity", "sec")


@check("t01_event_timeline", A.with_score("""SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY sec, category) AS ord,
    sec, category FROM events"""))
def t01(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("call_id").orderBy("sec", "category")
    return analysis(spark, d).events.select(
        "call_id", F.row_number().over(order).cast("bigint").alias("ord"), "sec", "category")


@check("t07_payoff_events", A.with_score(f"""SELECT call_id, sec, category FROM events WHERE category IN {sql_in(v.HARMFUL)}
    QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY sec, category) <= 3"""))
def t07(spark, d):
    from callward.operators.narrative import payoff_steps

    return payoff_steps(analysis(spark, d).events).select("call_id", "sec", "category")


@check("j08_event_badges", A.with_score(f"""SELECT s.call_id, s.seq, coalesce(string_agg(e.severity || ':' || e.category, '|'
    ORDER BY {sql_case('e.severity', A._SEV)} DESC, e.category), '') AS badges FROM seg s
    LEFT JOIN (SELECT DISTINCT call_id, seq, category, severity FROM events) e USING (call_id, seq) GROUP BY s.call_id, s.seq"""))
def j08(spark, d):
    out = ST.event_badges(segments(spark, d), analysis(spark, d).events)
    return out.select("call_id", "seq", joined("badges"))


@check("risk_per_conversation", A.with_score("""SELECT call_id, classification, confidence, stage, array_to_string(tactics, '|') AS tactics,
    risk_score, risk_level, alert_level FROM assessed"""))
def flagship(spark, d):
    return scored(spark, d).assessed.select(
        "call_id", "classification", "confidence", "stage", joined("tactics"), "risk_score", "risk_level", "alert_level")
