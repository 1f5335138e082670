"""Checks of live replay, stored tables, series and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from callward import vocab as v
from callward.operators import grounding as G
from callward.operators import live as L
from callward.operators import series as N
from callward.operators import store as ST
from callward.operators.cut import materialize
from callward.operators.prefix import blocks_of
from callward.operators.verdict import RECOMMENDED_ACTION
from callward.sources import readers as R
from callward.sources import writers as W
from checks import analysis_sql as A
from checks.common import (CONJUNCTIONS, MARKERS, PROSE, SQL_SEGMENTS, check, segments, sql_case, sql_in,
                           sql_quote_canon, sql_strip, sql_ts, table)

# --- live log: a user is a call, each event one update -------------------------------------------

_CAT = {"view": "URGENCY", "click": "FEAR", "signup": "REMOTE_ACCESS", "error": "OTP_REQUEST", "purchase": "MONEY_TRANSFER"}
_STG = {"view": "FEAR_ESCALATION", "click": "TRUST_BUILDING", "signup": "REMOTE_ACCESS", "error": "CREDENTIAL_EXTRACTION",
        "purchase": "MONEY_TRANSFER"}
_SQL_LOG = f"""u AS (SELECT user_id AS call_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS upd,
    least(100, floor(value))::INT AS risk_score, {sql_case('event_type', _CAT)} AS category, {sql_case('event_type', _STG)} AS stage,
    CASE WHEN value > 30 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, floor(value / 2)::BIGINT AS sec, event_type FROM events)"""


def log(spark, d):
    from callward.operators.prefix import running

    ev = table(spark, d, "events").selectExpr(
        "user_id AS call_id", "event_id", "ts", "CAST(least(100, floor(value)) AS INT) AS risk_score",
        f"{sql_case('event_type', _CAT)} AS category", f"{sql_case('event_type', _STG)} AS stage",
        "IF(value > 30, 'CRITICAL', 'HIGH') AS severity", "CAST(floor(value / 2) AS BIGINT) AS sec", "event_type")
    day = F.datediff("ts", F.lit("1970-01-01")).cast("bigint")
    return running(ev, ["call_id"], ["ts", "event_id"], day, {"upd": ("count", F.lit(1))}).withColumn(
        "upd", F.col("upd").cast("bigint")).drop("ts")


@check("w09_peak_hold", f"""WITH {_SQL_LOG}, p AS (SELECT call_id, upd, max(risk_score) OVER (PARTITION BY call_id ORDER BY upd) AS peak FROM u)
    SELECT call_id, upd, peak, CASE WHEN peak >= 80 THEN 'CRITICAL' WHEN peak >= 60 THEN 'HIGH_RISK' WHEN peak >= 30 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS peak_level FROM p""")
def w09(spark, d):
    return L.hold_peak(log(spark, d), 16).select("call_id", "upd", "peak", "peak_level")


@check("w10_fresh_events", f"WITH {_SQL_LOG} SELECT call_id, category, sec, min(upd) AS upd FROM u GROUP BY call_id, category, sec")
def w10(spark, d):
    ev = log(spark, d).withColumn("evidence", F.concat(F.lit("Said: "), F.col("category"))).select(
        "call_id", "category", "sec", "upd", "severity", "evidence")
    return L.fresh_events(ev).select("call_id", "category", "sec", "upd")


@check("w11_accumulated_labels", f"""WITH {_SQL_LOG}, f AS (SELECT call_id, category, min(upd) AS first FROM u GROUP BY ALL)
    SELECT u.call_id, u.upd, string_agg(f.category, '|' ORDER BY f.first) AS labels FROM u JOIN f ON f.call_id = u.call_id AND f.first <= u.upd GROUP BY u.call_id, u.upd""")
def w11(spark, d):
    df = log(spark, d).withColumn("tactics", F.array("category"))
    return L.accumulate_labels(df, "tactics").select("call_id", "upd", F.array_join("all_tactics", "|").alias("labels"))


_DEPTH = sql_case("stage", v.STAGE_DEPTH)


@check("w12_deepest_stage", f"""WITH {_SQL_LOG} SELECT call_id, upd, max({_DEPTH}) OVER (PARTITION BY call_id ORDER BY upd)::INT AS depth FROM u""")
def w12(spark, d):
    return L.deepest_stage(log(spark, d), 16).select("call_id", "upd", L.stage_depth("deepest_stage").alias("depth"))


@check("w13_stage_timeline", f"""WITH {_SQL_LOG}, a AS (SELECT *, {_DEPTH} AS depth, lag(stage) OVER (PARTITION BY call_id ORDER BY upd) AS before FROM u),
    e AS (SELECT * FROM a WHERE before IS NULL OR before <> stage),
    m AS (SELECT *, max(depth) OVER (PARTITION BY call_id ORDER BY upd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deepest FROM e)
    SELECT call_id, upd, stage FROM m WHERE deepest IS NULL OR depth >= deepest""")
def w13(spark, d):
    return L.stage_timeline(log(spark, d), 16).select("call_id", "upd", "stage")


_CAND = "CASE WHEN risk_score >= 80 THEN 3 WHEN risk_score >= 60 THEN 2 WHEN risk_score >= 30 THEN 1 ELSE 0 END"


@check("w14_escalating_alerts", f"""WITH {_SQL_LOG}, r AS (SELECT *, {_CAND} AS rank FROM u),
    h AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY call_id ORDER BY upd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS highest FROM r)
    SELECT call_id, upd, CASE rank WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'MONITOR' END AS level, risk_score FROM h WHERE rank > highest""")
def w14(spark, d):
    df = log(spark, d)
    none = df.selectExpr("call_id", "category", "sec", "upd", "'LOW' AS severity", "'' AS evidence")
    return L.alert_stream(df.select("call_id", "upd", "risk_score"), none, block=16).select("call_id", "upd", "level", "risk_score")


@check("w15_critical_alerts", f"""WITH {_SQL_LOG}, f AS (SELECT call_id, category, severity, sec, min(upd) AS upd FROM u GROUP BY ALL)
    SELECT call_id, category, min(upd) AS upd FROM f WHERE severity = 'CRITICAL' AND category IN {sql_in(v.HARMFUL)} GROUP BY ALL""")
def w15(spark, d):
    fresh = L.fresh_events(log(spark, d).selectExpr("call_id", "category", "sec", "upd", "severity", "severity AS evidence"))
    return L.critical_alerts(fresh).select("call_id", "category", "upd")


@check("w15_one_alert_per_update", f"""WITH RECURSIVE {_SQL_LOG},
    c AS (SELECT call_id, category, upd // 4 AS upd, min(sec) AS sec FROM (SELECT call_id, category, severity, sec, min(upd) AS upd FROM u GROUP BY ALL)
      WHERE severity = 'CRITICAL' AND category IN {sql_in(v.HARMFUL)} GROUP BY ALL),
    q AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY upd, sec, category) AS k FROM c),
    fold AS (SELECT DISTINCT call_id, 0::BIGINT AS k, []::VARCHAR[] AS seen, -1::BIGINT AS used, NULL::VARCHAR AS category, false AS fired FROM q
      UNION ALL SELECT f.call_id, q.k, CASE WHEN NOT list_contains(f.seen, q.category) AND f.used <> q.upd THEN list_append(f.seen, q.category) ELSE f.seen END,
        CASE WHEN NOT list_contains(f.seen, q.category) AND f.used <> q.upd THEN q.upd ELSE f.used END, q.category,
        NOT list_contains(f.seen, q.category) AND f.used <> q.upd FROM fold f JOIN q ON q.call_id = f.call_id AND q.k = f.k + 1)
    SELECT call_id, category, used AS upd FROM fold WHERE fired""")
def w15c(spark, d):
    fresh = L.fresh_events(log(spark, d).selectExpr("call_id", "category", "sec", "upd", "severity", "severity AS evidence"))
    return L.critical_alerts(fresh.withColumn("upd", F.floor(F.col("upd") / 4)), True).select("call_id", "category", "upd")


@check("w16_segments_added", f"""WITH {_SQL_LOG}, n AS (SELECT call_id, upd, upd + 1 + risk_score % 3 AS n_seen FROM u)
    SELECT call_id, upd, greatest(n_seen - coalesce(lag(n_seen) OVER (PARTITION BY call_id ORDER BY upd), 0), 0) AS added FROM n""")
def w16(spark, d):
    df = log(spark, d).withColumn("n_seen", F.col("upd") + 1 + F.col("risk_score") % 3)
    return L.segments_added(df, 16).select("call_id", "upd", F.col("added").cast("bigint").alias("added"))


@check("w07_growing_prefixes", f"""WITH {_SQL_LOG}, n AS (SELECT call_id, max(upd) + 1 AS n FROM u GROUP BY call_id),
    j AS (SELECT call_id, least(j * 3, n) - 1 AS upd FROM n, LATERAL (SELECT unnest(range(1, (n + 2) // 3 + 1)) AS j))
    SELECT j.call_id, j.upd, count(*) AS rows, sum(u.risk_score)::BIGINT AS total FROM j JOIN u ON u.call_id = j.call_id AND u.upd <= j.upd AND u.upd > j.upd - 40 GROUP BY j.call_id, j.upd""")
def w07(spark, d):
    seg = log(spark, d).withColumnRenamed("upd", "seq")
    return L.updates(seg, step=3).groupBy("call_id", "upd").agg(
        F.count("*").alias("rows"), F.sum("risk_score").alias("total")).withColumn("upd", F.col("upd").cast("bigint"))


@check("w08_context_window", f"""WITH {SQL_SEGMENTS} SELECT a.call_id, a.seq AS upd, count(*) AS rows, min(b.seq) AS first FROM seg a JOIN seg b
    ON a.call_id = b.call_id AND b.seq <= a.seq AND b.seq > a.seq - 3 GROUP BY a.call_id, a.seq""")
def w08(spark, d):
    return L.updates(segments(spark, d), window=3).groupBy("call_id", "upd").agg(
        F.count("*").alias("rows"), F.min("seq").cast("bigint").alias("first")).withColumn("upd", F.col("upd").cast("bigint"))


@check("live_replay", f"""WITH RECURSIVE {A.over_windows(v.CONTEXT_WINDOW, False)} {A.SQL_HELD}
    SELECT call_id, upd, risk_score, peak, CASE WHEN peak >= 80 THEN 'CRITICAL' WHEN peak >= 60 THEN 'HIGH_RISK' WHEN peak >= 30 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS peak_level,
      stage, deepest_stage, all_tactics FROM deep""")
def live_replay(spark, d):
    """Every conversation analysed after each turn with the batch plan, then held and merged."""
    from callward.plans.live import replay

    return replay(segments(spark, d), PROSE, MARKERS, CONJUNCTIONS).updates.select(
        "call_id", "upd", "risk_score", "peak", "peak_level", "stage", "deepest_stage",
        F.array_join("all_tactics", "|").alias("all_tactics"))


@check("k09_update_frames")
def k09(spark, d):
    from callward.plans.live import frames, replay

    return frames(replay(segments(spark, d), PROSE, MARKERS, CONJUNCTIONS))


@check("k09_frame_fields", f"""WITH RECURSIVE {A.over_windows(v.CONTEXT_WINDOW, False)} {A.SQL_HELD},
    newest AS (SELECT call_id, upd, category, sec, severity FROM seen
      QUALIFY row_number() OVER (PARTITION BY call_id, upd ORDER BY sec DESC, category DESC, severity DESC) = 1),
    top AS (SELECT call_id, upd, max(category) AS category FROM crit GROUP BY 1, 2)
    SELECT call_id, upd, 'risk_update' AS type, risk_score, risk_level AS classification, classification AS model_classification, stage AS current_stage,
      all_tactics AS detected_tactics, peak AS peak_risk_score, upd + 1 AS segments_seen, newest.category AS event_category, newest.sec AS event_sec,
      newest.severity AS event_severity,
      CASE WHEN n_crit > 0 THEN 'CRITICAL' WHEN rank > highest THEN CASE rank WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'MONITOR' END END AS alert_level,
      CASE WHEN n_crit > 0 THEN top.category WHEN rank > highest THEN 'risk_score' END AS alert_trigger
    FROM deep LEFT JOIN newest USING (call_id, upd) LEFT JOIN top USING (call_id, upd)""")
def k09f(spark, d):
    """The fields of the live frames, read back from their JSON."""
    schema = ("type string, call_id string, risk_score int, classification string, model_classification string, current_stage string, "
              "detected_tactics array<string>, peak_risk_score int, segments_seen bigint, "
              "event struct<sec:bigint,category:string,severity:string,evidence:string>, alert struct<level:string,triggered_by:string,risk_score:int>")
    f = k09(spark, d).select("call_id", "upd", F.from_json("frame", schema).alias("f"))
    return f.filter("f.call_id = CAST(call_id AS STRING)").select(
        "call_id", "upd", "f.type", "f.risk_score", "f.classification", "f.model_classification", "f.current_stage",
        F.array_join("f.detected_tactics", "|").alias("detected_tactics"), "f.peak_risk_score", "f.segments_seen",
        F.col("f.event.category").alias("event_category"), F.col("f.event.sec").alias("event_sec"), F.col("f.event.severity").alias("event_severity"),
        F.col("f.alert.level").alias("alert_level"), F.col("f.alert.triggered_by").alias("alert_trigger"))


@check("k10_report_lines")
def k10(spark, d):
    from callward.operators import score
    from checks.score_checks import scored

    s = scored(spark, d)
    return W.report_lines(s.assessed, s.partitioned, score.ledger(s.assessed, s.partitioned), segments(spark, d))


@check("k10_report_rows", A.with_score(f"""SELECT call_id, 2 AS section, (p - 1)::DOUBLE AS ord, '- ' || a AS line
      FROM (SELECT call_id, unnest(requested_actions) AS a, generate_subscripts(requested_actions, 1) AS p FROM assessed)
    UNION ALL SELECT call_id, 3, sec::DOUBLE, '| `' || {sql_ts('sec')} || '` | ' || speaker || ' | ' || category || ' | ' || severity || ' | '
      || replace(evidence, '|', chr(92) || '|') || ' |' FROM part
    UNION ALL SELECT call_id, 5, seq::DOUBLE, '[' || {sql_ts('start')} || '] ' || speaker || ': ' || text FROM seg"""))
def k10r(spark, d):
    """Requested actions, events and the transcript of every report; facts and ledger have checks of their own."""
    return k10(spark, d).filter("section IN (2, 3, 5)")


@check("p24_explanations")
def p24(spark, d):
    from callward.operators import narrative
    from checks.score_checks import scored

    s = scored(spark, d)
    return narrative.explain(s.summary, s.events, s.observations).join(
        narrative.explain_score(s.assessed, s.partitioned), "call_id")


@check("k11_public_json")
def k11(spark, d):
    from callward.operators import narrative
    from callward.operators.verdict import RECOMMENDED_ACTION, lookup
    from checks.score_checks import scored

    s = scored(spark, d)
    verdicts = s.assessed.join(narrative.explain(s.summary, s.events, s.observations), "call_id").withColumn(
        "recommended_action", F.expr(lookup("classification", RECOMMENDED_ACTION)))
    return W.public_json(verdicts, s.events)


@check("k11_public_fields", A.with_score(f"""SELECT v.call_id, classification, confidence, array_to_string(scam_types, '|') AS scam_types,
      array_to_string(tactics, '|') AS tactics, stage, array_to_string(requested_actions, '|') AS requested_actions, coalesce(factors, '') AS factors,
      {sql_case('classification', RECOMMENDED_ACTION)} AS recommended_action
    FROM verdict v LEFT JOIN (SELECT call_id, string_agg({sql_ts('sec')} || ' ' || category || ' ' || severity || ' ' || speaker || ' ' || evidence, '|'
      ORDER BY sec, category) AS factors FROM events GROUP BY 1) e ON e.call_id = v.call_id"""))
def k11f(spark, d):
    """The fields of the public JSON but the explanation, read back."""
    schema = ("classification string, confidence double, scam_types array<string>, tactics array<string>, conversation_stage string, "
              "requested_actions array<string>, risk_factors array<struct<timestamp:string,speaker:string,category:string,severity:string,evidence:string>>, "
              "explanation string, recommended_action string")
    f = k11(spark, d).select("call_id", F.from_json("payload", schema).alias("f")).filter("length(f.explanation) > 0")
    joined = lambda c: F.array_join(f"f.{c}", "|").alias(c)
    factors = F.transform("f.risk_factors", lambda x: F.concat_ws(" ", x["timestamp"], x["category"], x["severity"], x["speaker"], x["evidence"]))
    return f.select("call_id", "f.classification", "f.confidence", joined("scam_types"), joined("tactics"), F.col("f.conversation_stage").alias("stage"),
                    joined("requested_actions"), F.array_join(factors, "|").alias("factors"), "f.recommended_action")


# --- grounding: conversation clauses and benchmark sentences as quotes ---------------------------

_QUOTES = """SELECT conv_id AS call_id, turn * 2 AS quote_id, split_part(text, '.', 2) AS evidence FROM conversations
    UNION ALL SELECT conv_id, turn * 2 + 1, substr(text, 5, 40) FROM conversations"""


def quotes(spark, d):
    conv = table(spark, d, "conversations")
    return conv.selectExpr("conv_id AS call_id", "turn * 2 AS quote_id", "split_part(text, '.', 2) AS evidence").unionAll(
        conv.selectExpr("conv_id AS call_id", "turn * 2 + 1 AS quote_id", "substr(text, 5, 40) AS evidence"))


_SQL_GROUND = f"""WITH {SQL_SEGMENTS}, q AS (SELECT call_id, quote_id, {sql_quote_canon('evidence')} AS needle FROM ({_QUOTES})),
    h AS (SELECT call_id, seq, {sql_quote_canon('text')} AS hay FROM seg)
    SELECT q.call_id, q.quote_id, min(h.seq) AS seq FROM q JOIN h ON q.call_id = h.call_id AND (contains(hay, needle) OR contains(needle, hay))
    WHERE needle <> '' AND hay <> '' GROUP BY ALL"""


def _needles(spark, d):
    from callward.functions import text as T

    return quotes(spark, d).select("call_id", "quote_id", T.quote_canon(F.col("evidence")).alias("needle")).filter("needle <> ''")


@check("j03_grounding_containment", _SQL_GROUND)
def j03(spark, d):
    # both are read several times
    return G.contained(materialize(_needles(spark, d), "quotes"), materialize(G.haystacks(segments(spark, d)), "utterances"))


@check("j03_grounding_by_grams", _SQL_GROUND)
def j03g(spark, d):
    """Through `locate`, without what only similarity finds."""
    return G.locate(quotes(spark, d), segments(spark, d)).filter("by = 'containment'").select("call_id", "quote_id", "seq")


@check("j04_speaker_repair", _SQL_GROUND.replace("SELECT q.call_id, q.quote_id, min(h.seq) AS seq", "SELECT x.call_id, quote_id, s.speaker, " + sql_ts("s.start") + " AS timestamp FROM (SELECT q.call_id, q.quote_id, min(h.seq) AS seq")
       + ") x JOIN seg s ON s.call_id = x.call_id AND s.seq = x.seq")
def j04(spark, d):
    from callward.functions import text as T

    ev = quotes(spark, d).withColumns({"category": F.lit("FEAR"), "speaker": F.lit("?"), "start": F.lit(0.0)})
    kept, _ = G.ground(ev, segments(spark, d))
    return kept.filter("grounded_by = 'containment'").select("call_id", "quote_id", "speaker", T.fmt_ts(F.col("start")).alias("timestamp"))


@check("j03_grounding_fuzzy")
def j03f(spark, d):
    """Quotes with every ninth letter changed, so that containment fails for most."""
    ev = quotes(spark, d).withColumn("evidence", F.regexp_replace("evidence", "(.{8}).", "$1z")).withColumn("category", F.lit("FEAR"))
    kept, dropped = G.ground(ev, segments(spark, d))
    return kept.select("call_id", "quote_id", "segment_index", "grounding_score").unionByName(
        dropped.selectExpr("call_id", "quote_id", "CAST(NULL AS BIGINT) AS segment_index", "0D AS grounding_score"))


@check("s07_model_completions", """SELECT event_id, event_type <> 'error' AS valid,
    CASE event_type WHEN 'view' THEN 'SCAM' WHEN 'click' THEN 'SUSPICIOUS' ELSE 'SAFE' END AS classification,
    CASE event_type WHEN 'error' THEN 0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE WHEN 'click' THEN 0.25::DOUBLE ELSE 1::DOUBLE END AS confidence,
    CASE WHEN event_type = 'view' THEN 'OTP_THEFT' ELSE '' END AS scam_types FROM events""")
def s07(spark, d):
    text = (F.when(F.col("event_type") == "view", '```json\n{"classification": "SCAM", "confidence": 0.5, "scam_types": ["otp theft", "nope"]}\n```')
            .when(F.col("event_type") == "click", 'Answer: {"classification": "SUSPICIOUS", "confidence": 0.25, "explanation": "a } in \\"text\\""} done')
            .when(F.col("event_type") == "error", '{"classification": "SCAM", "confidence": 0.5').otherwise('{"classification": "SAFE", "confidence": 1}'))
    out = R.completions(table(spark, d, "events").select("event_id", text.alias("completion")))
    return out.select("event_id", "valid", "classification", "confidence", F.array_join("scam_types", "|").alias("scam_types"))


# --- stored tables: orders are calls, their lines are stored rows ---------------------------------

_NOW = "1998-06-01 00:00:00"


def stored_calls(spark, d):
    days = ST.retention(F.col("o_orderdate"), 30, 180)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").alias("started_at"),
        F.expr("IF(o_orderstatus = 'F', o_orderdate, NULL)").alias("ended_at"), F.lit(10.0).alias("duration"),
        F.lit("ru").alias("language"), F.lit("inbound").alias("call_direction"),
        F.expr("CAST(o_totalprice % 101 AS INT)").alias("final_risk"), F.col("o_orderpriority").alias("risk_level"),
        F.expr("CAST(o_totalprice % 101 AS INT)").alias("peak_risk"), F.lit("analyzed").alias("status"),
        F.lit(0.9).alias("mean_confidence"), F.expr("IF(o_custkey % 2 = 0, 'rec', NULL)").alias("recording_ref"),
        days["recording_purge_after"].alias("recording_purge_after"), days["transcript_purge_after"].alias("transcript_purge_after"),
        F.expr("IF(o_orderstatus = 'P', o_orderdate, NULL)").alias("deleted_at"))


def stored_lines(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS call_id", "CAST(l_linenumber AS BIGINT) AS seq", "IF(l_returnflag = 'R', '[purged]', l_linestatus) AS text_masked",
        "l_returnflag AS category", "l_linestatus AS evidence", "l_shipdate AS created_at", "l_partkey AS id", "l_quantity")


_SQL_CALLS = """c AS (SELECT o_orderkey AS call_id, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS ended_at,
  floor(o_totalprice % 101)::INT AS final_risk, o_orderpriority AS risk_level, CASE WHEN o_custkey % 2 = 0 THEN 'rec' END AS recording_ref,
  o_orderdate + INTERVAL 30 DAY AS rec_due, o_orderdate + INTERVAL 180 DAY AS txt_due, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at FROM orders)"""


@check("k07_upsert_calls", f"""WITH {_SQL_CALLS}, i AS (SELECT o_orderkey + 5000 AS call_id, floor(o_totalprice % 97)::INT AS risk_score, o_orderpriority AS level FROM orders)
    SELECT coalesce(c.call_id, i.call_id) AS call_id, coalesce(i.risk_score, final_risk) AS final_risk,
      CASE WHEN i.call_id IS NULL THEN final_risk ELSE greatest(coalesce(final_risk, 0), i.risk_score) END AS peak_risk,
      strftime(CASE WHEN i.call_id IS NULL THEN ended_at ELSE coalesce(ended_at, TIMESTAMP '{_NOW}') END, '%Y-%m-%d') AS ended,
      strftime(coalesce(started_at, TIMESTAMP '{_NOW}') + INTERVAL 30 DAY, '%Y-%m-%d') AS purge, coalesce(i.level, risk_level) AS risk_level
    FROM c FULL JOIN i ON c.call_id = i.call_id""")
def k07(spark, d):
    incoming = table(spark, d, "orders").selectExpr(
        "o_orderkey + 5000 AS call_id", "5D AS duration", "'kk' AS language", "'outbound' AS call_direction",
        "CAST(o_totalprice % 97 AS INT) AS risk_score", "o_orderpriority AS risk_level", "0.5D AS mean_confidence", "'r' AS recording_ref")
    out = ST.upsert_calls(stored_calls(spark, d), incoming, F.to_timestamp(F.lit(_NOW)))
    return out.select("call_id", "final_risk", "peak_risk", F.date_format("ended_at", "yyyy-MM-dd").alias("ended"),
                      F.date_format("recording_purge_after", "yyyy-MM-dd").alias("purge"), "risk_level")


@check("k07_replace_children", """WITH n AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F')
    SELECT l_orderkey AS call_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM n) GROUP BY 1 UNION ALL SELECT k, 1 FROM n""")
def k07c(spark, d):
    calls = table(spark, d, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS call_id")
    fresh = calls.selectExpr("call_id", "0L AS seq")
    return ST.replace_children(stored_lines(spark, d).select("call_id", "seq"), fresh, calls).groupBy("call_id").agg(F.count("*").alias("n"))


@check("f07_not_deleted", f"WITH {_SQL_CALLS} SELECT call_id FROM c WHERE deleted_at IS NULL")
def f07(spark, d):
    return ST.visible(stored_calls(spark, d)).select("call_id")


@check("t03_recent_calls", f"WITH {_SQL_CALLS} SELECT call_id, final_risk FROM c WHERE deleted_at IS NULL ORDER BY started_at DESC, call_id LIMIT 50")
def t03(spark, d):
    return ST.recent_calls(stored_calls(spark, d)).select("call_id", "final_risk")


@check("w06_newest_analysis", """SELECT l_orderkey AS call_id, l_partkey AS id, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC) = 1""")
def w06(spark, d):
    return ST.newest_analysis(stored_lines(spark, d).select("call_id", "created_at", "id", "l_quantity")).select("call_id", "id", "l_quantity")


@check("j09_call_children", f"""WITH {_SQL_CALLS} SELECT c.call_id, count(l_orderkey) AS n_rows FROM c LEFT JOIN lineitem ON l_orderkey = c.call_id
    WHERE deleted_at IS NULL GROUP BY c.call_id""")
def j09(spark, d):
    return ST.visible(stored_calls(spark, d)).join(stored_lines(spark, d), "call_id", "left").groupBy("call_id").agg(F.count("seq").alias("n_rows"))


@check("s09_read_call", f"""WITH {_SQL_CALLS}, x AS (SELECT min(call_id) AS k FROM c WHERE deleted_at IS NULL)
    SELECT l_linenumber::BIGINT AS seq, l_returnflag AS category FROM lineitem JOIN x ON l_orderkey = k""")
def s09(spark, d):
    calls, lines = stored_calls(spark, d), stored_lines(spark, d)
    first = ST.visible(calls).agg(F.min("call_id")).first()[0]
    return ST.read_call(calls, lines, lines, lines.select("call_id", "created_at", "id"), first)["events"].select("seq", "category")


@check("s10_rebuild_transcript", f"""WITH {SQL_SEGMENTS} SELECT call_id, seq, md5(text) AS text, CASE WHEN seq % 2 = 0 THEN md5(text) ELSE md5('orig') END AS text_original FROM seg""")
def s10(spark, d):
    stored = segments(spark, d).selectExpr(
        "call_id", "seq", "speaker", "start", "end", "language", "text AS text_masked", "IF(seq % 2 = 0, NULL, 'orig') AS text_original", "confidence")
    return ST.to_segments(stored).selectExpr("call_id", "seq", "md5(CAST(text AS BINARY)) AS text", "md5(CAST(text_original AS BINARY)) AS text_original")


@check("a34_store_stats", f"""WITH {_SQL_CALLS} SELECT 'calls' AS section, '' AS key, count(*) AS n FROM c
    UNION ALL SELECT 'risk_level', risk_level, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'category', l_returnflag, count(*) FROM lineitem GROUP BY ALL""")
def a34(spark, d):
    return ST.store_stats(stored_calls(spark, d), stored_lines(spark, d))


@check("t04_events_by_count", """SELECT l_returnflag AS category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS rank FROM lineitem GROUP BY 1""")
def t04(spark, d):
    from pyspark.sql import Window

    counts = ST.store_stats(stored_calls(spark, d), stored_lines(spark, d)).filter("section = 'category'")
    # one row per category of a closed vocabulary
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "key")).cast("bigint")
    return counts.select(F.col("key").alias("category"), "n", rank.alias("rank"))


@check("g03_soft_delete", """SELECT l_orderkey AS call_id, l_linenumber::BIGINT AS seq, CASE WHEN o_orderstatus = 'F' THEN '[deleted]' ELSE
    CASE WHEN l_returnflag = 'R' THEN '[purged]' ELSE l_linestatus END END AS text_masked FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def g03(spark, d):
    ids = table(spark, d, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS call_id")
    lines = stored_lines(spark, d)
    return ST.soft_delete(stored_calls(spark, d), lines, lines, ids, F.to_timestamp(F.lit(_NOW)))[1].select("call_id", "seq", "text_masked")


@check("g03_hard_delete", """SELECT 'calls' AS name, count(*) AS n FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'segments', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def g03h(spark, d):
    ids = table(spark, d, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS call_id")
    left = ST.hard_delete({"calls": stored_calls(spark, d), "segments": stored_lines(spark, d)}, ids)
    return left["calls"].agg(F.count("*").alias("n")).select(F.lit("calls").alias("name"), "n").unionByName(
        left["segments"].agg(F.count("*").alias("n")).select(F.lit("segments").alias("name"), "n"))


@check("g03_erased_on_disk", "SELECT o_orderkey AS call_id FROM orders WHERE o_orderstatus <> 'F'")
def g03d(spark, d):
    """Delete, save, read back: buckets that lose all their calls must not keep them."""
    from callward.operators.cut import scratch
    from callward.sources import writers as W

    path = scratch(spark, "stored") + "/calls"
    calls = table(spark, d, "orders").selectExpr("o_orderkey AS call_id", "o_orderstatus AS status")
    W.save_table(calls, path, 64)
    ids = calls.filter("status = 'F'").select("call_id")
    W.save_table(ST.hard_delete({"calls": W.load_table(spark, path)}, ids)["calls"], path, 64)
    # every file below the folder, whatever version it is of
    return spark.read.option("recursiveFileLookup", "true").parquet(path).select("call_id")


_DUE = f"TIMESTAMP '{_NOW}'"


@check("g04_retention_purge", f"""WITH {_SQL_CALLS} SELECT (SELECT count(*) FROM c WHERE rec_due <= {_DUE} AND recording_ref IS NOT NULL) AS recordings,
    (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN c ON l_orderkey = call_id WHERE txt_due <= {_DUE} AND l_returnflag <> 'R') AS transcripts""")
def g04(spark, d):
    return ST.purge_expired(stored_calls(spark, d), stored_lines(spark, d), F.to_timestamp(F.lit(_NOW)))[2]


@check("g04_purged_rows", f"""WITH {_SQL_CALLS} SELECT count(*) AS n FROM lineitem LEFT JOIN c ON l_orderkey = call_id WHERE l_returnflag = 'R' OR txt_due <= {_DUE}""")
def g04r(spark, d):
    segs = ST.purge_expired(stored_calls(spark, d), stored_lines(spark, d), F.to_timestamp(F.lit(_NOW)))[1]
    return segs.filter("text_masked = '[purged]'").agg(F.count("*").alias("n"))


@check("g05_leak_scan", "SELECT doc_id FROM documents WHERE doc_id % 50 = 0")
def g05(spark, d):
    """After masking nothing is left to mask, over all documents, but where a code was written behind it."""
    masked = ST.masked_fields(table(spark, d, "documents").select("doc_id", "text"), "text")
    planted = F.when(F.col("doc_id") % 50 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" otp code 482913"))).otherwise(F.col("text"))
    return ST.leak_scan(masked.withColumn("text", planted), "text").select("doc_id")


# --- series: embeddings are sampled signals --------------------------------------------------------

RATE, FRAME = 100, 4


def samples(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("series_id"), F.posexplode("embedding").alias("i", "x")).select(
        "series_id", F.col("i").cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))


_SQL_SAMPLES = "s AS (SELECT vec_id AS series_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_SQL_FRAMES = f"{_SQL_SAMPLES}, f AS (SELECT series_id, i // {FRAME} AS frame, 20 * log10(sqrt(avg(x * x)) + 1e-9) AS level FROM s GROUP BY ALL)"
_SQL_LIMITS = f"""{_SQL_FRAMES}, o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY level) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM f),
  lim AS (SELECT series_id, max(level) FILTER (r = floor(n * 0.15)) AS noise_floor, max(level) FILTER (r = floor(n * 0.95)) AS peak, max(n) AS n FROM o GROUP BY series_id)"""


@check("n01_frame_levels", f"WITH {_SQL_FRAMES} SELECT series_id, frame, round(level, 6) AS level FROM f")
def n01(spark, d):
    return N.frame_levels(samples(spark, d), FRAME).select("series_id", "frame", F.round("level", 6).alias("level"))


@check("n02_adaptive_threshold", f"WITH {_SQL_LIMITS} SELECT series_id, round(noise_floor, 6) AS noise_floor, round(peak, 6) AS peak, peak - noise_floor < 6 AS flat FROM lim")
def n02(spark, d):
    return N.thresholds(N.frame_levels(samples(spark, d), FRAME)).select(
        "series_id", F.round("noise_floor", 6).alias("noise_floor"), F.round("peak", 6).alias("peak"), "flat")


# frames of 0.1 s: gaps of 3 silent frames close a region, regions need 3 frames
_SQL_REGIONS = f"""{_SQL_LIMITS}, v AS (SELECT f.series_id, frame, n FROM f JOIN lim USING (series_id) WHERE peak - noise_floor >= 6 AND level > noise_floor + 2),
  g AS (SELECT *, CASE WHEN frame - coalesce(lag(frame) OVER (PARTITION BY series_id ORDER BY frame), -99) > 3 THEN 1 ELSE 0 END AS fresh FROM v),
  w AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY frame) AS island FROM g),
  r0 AS (SELECT series_id, min(frame) AS a, max(frame) AS z, max(n) AS n FROM w GROUP BY series_id, island),
  r AS (SELECT series_id, a AS first_frame, CASE WHEN n - 1 - z < 3 THEN n - 1 ELSE z END AS last_frame FROM r0),
  regions AS (SELECT * FROM r WHERE last_frame - first_frame + 1 >= 3 UNION ALL SELECT series_id, 0, n - 1 FROM lim WHERE peak - noise_floor < 6)"""


def regions(spark, d):
    frames = N.frame_levels(samples(spark, d), FRAME)
    return N.active_regions(frames, N.thresholds(frames, margin_db=2.0), 0.1)


@check("n03_active_regions", f"WITH {_SQL_REGIONS} SELECT series_id, first_frame, last_frame FROM regions")
def n03(spark, d):
    return regions(spark, d).select("series_id", "first_frame", "last_frame")


@check("n04_region_features", f"""WITH {_SQL_REGIONS}, x AS (SELECT s.series_id, first_frame, i, x, lag(x) OVER (PARTITION BY s.series_id, first_frame ORDER BY i) AS p
      FROM s JOIN regions q ON s.series_id = q.series_id AND i // {FRAME} BETWEEN first_frame AND last_frame)
    SELECT series_id, first_frame, round(20 * log10(sqrt(avg(x * x)) + 1e-9), 6) AS level,
      round(100.0::DOUBLE * count(*) FILTER (p IS NOT NULL AND (p >= 0) <> (x >= 0)) / greatest(count(*) - 1, 1), 6) AS crossings FROM x GROUP BY series_id, first_frame""")
def n04(spark, d):
    return N.region_features(samples(spark, d), regions(spark, d), FRAME).select(
        "series_id", "first_frame", F.round("level", 6).alias("level"), F.round("crossings", 6).alias("crossings"))


@check("n05_two_clusters", f"""WITH RECURSIVE {_SQL_SAMPLES},
    w AS (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY i) AS p FROM s),
    f AS (SELECT series_id, 20 * log10(sqrt(avg(x * x)) + 1e-9) AS level,
      100.0::DOUBLE * count(*) FILTER (p IS NOT NULL AND (p >= 0) <> (x >= 0)) / greatest(count(*) - 1, 1) AS crossings FROM w GROUP BY series_id),
    pts AS (SELECT label::BIGINT AS g, series_id AS r, level, crossings FROM f JOIN embeddings ON vec_id = series_id),
    c AS (SELECT g, 0 AS k, first(level ORDER BY level, crossings) AS al, first(crossings ORDER BY level, crossings) AS ac,
        first(level ORDER BY level DESC, crossings DESC) AS bl, first(crossings ORDER BY level DESC, crossings DESC) AS bc FROM pts GROUP BY g
      UNION ALL SELECT c.g, c.k + 1, coalesce(avg(level) FILTER (NOT far), max(al)), coalesce(avg(crossings) FILTER (NOT far), max(ac)),
        coalesce(avg(level) FILTER (far), max(bl)), coalesce(avg(crossings) FILTER (far), max(bc))
      FROM (SELECT c.*, level, crossings, (level - al) ** 2 + (crossings - ac) ** 2 > (level - bl) ** 2 + (crossings - bc) ** 2 AS far
        FROM c JOIN pts ON pts.g = c.g WHERE c.k < 24) c GROUP BY c.g, c.k)
    SELECT c.g AS series_id, r AS first_frame, ((level - al) ** 2 + (crossings - ac) ** 2 > (level - bl) ** 2 + (crossings - bc) ** 2)::BIGINT AS cluster
    FROM c JOIN pts ON pts.g = c.g WHERE k = 24""")
def n05(spark, d):
    """Vectors of one label form a group; each vector is one region."""
    pts = N.region_features(samples(spark, d), N.thresholds(N.frame_levels(samples(spark, d), FRAME)).selectExpr(
        "series_id", "0L AS first_frame", "n - 1 AS last_frame"), FRAME)
    lab = table(spark, d, "embeddings").selectExpr("vec_id AS series_id", "label")
    grouped = pts.join(lab, "series_id").selectExpr("CAST(label AS BIGINT) AS series_id", "series_id AS first_frame", "level", "crossings")
    return N.two_clusters(grouped)


@check("n06_assign_roles", """WITH t AS (SELECT user_id AS series_id, event_id AS pos, event_type AS cluster FROM events),
    f AS (SELECT series_id, cluster, min(pos) AS p0 FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p0) AS k FROM f)
    SELECT series_id, cluster, CASE WHEN k > 2 THEN 'UNKNOWN' WHEN (k = 1) = (series_id % 2 = 0) THEN 'VICTIM' ELSE 'CALLER' END AS speaker FROM r""")
def n06(spark, d):
    return N.assign_roles(table(spark, d, "events").selectExpr(
        "user_id AS series_id", "event_id AS pos", "event_type AS cluster", "IF(user_id % 2 = 0, 'inbound', 'outbound') AS call_direction"))


@check("n07_resample", f"""WITH {_SQL_SAMPLES}, j AS (SELECT vec_id AS series_id, unnest(range(160)) AS j FROM embeddings),
    p AS (SELECT *, j * 2 // 5 AS l, (j * 2 % 5) / 5.0::DOUBLE AS frac FROM j)
    SELECT p.series_id, j AS i, round(a.x * (1 - frac) + b.x * frac, 6) AS x FROM p JOIN s a ON a.series_id = p.series_id AND a.i = l
      JOIN s b ON b.series_id = p.series_id AND b.i = least(l + 1, 63)""")
def n07(spark, d):
    return N.resample(samples(spark, d), 2, 5).select("series_id", "i", F.round("x", 6).alias("x"))


@check("n08_time_slice", f"WITH {_SQL_SAMPLES} SELECT series_id, i FROM s WHERE i >= 10 AND i < 30")
def n08(spark, d):
    return N.slice_seconds(samples(spark, d), RATE, 0.1, 0.3).select("series_id", "i")


@check("st03_tumbling_chunks", """SELECT user_id AS call_id, (epoch_us(ts) // 1000000 // 3600)::BIGINT AS chunk, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def st03(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("call_id"), F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        "call_id", F.floor(F.unix_timestamp("w.start") / 3600).alias("chunk"), "n", "total")


@check("st03_count_chunks", f"WITH {_SQL_SAMPLES} SELECT series_id, i // 24 AS chunk, count(*) AS n FROM s GROUP BY ALL")
def st03n(spark, d):
    return N.chunks(samples(spark, d), 24).groupBy("series_id", "chunk").agg(F.count("*").alias("n"))


@check("k08_audit_rows", f"""WITH {_SQL_CALLS} SELECT 'check' AS actor, 'save_analysis' AS action, call_id::VARCHAR AS call_id, 'risk=' || final_risk AS detail FROM c""")
def k08(spark, d):
    return W.audit_rows(stored_calls(spark, d), "save_analysis", "check", F.concat(F.lit("risk="), "final_risk")).drop("at")


@check("g01_masked_encrypted_copy", f"""WITH {SQL_SEGMENTS} SELECT call_id, seq, md5(text) AS text_masked, md5(text) AS opened, true AS hidden FROM seg""")
def g01(spark, d):
    """Encrypted copies open with the key; without a key nothing is stored."""
    key = F.lit("0123456789abcdef")
    kept = ST.stored_segments(segments(spark, d), key)
    none = ST.stored_segments(segments(spark, d), None).select("call_id", "seq", F.col("text_encrypted").isNull().alias("hidden"))
    return kept.join(none, ["call_id", "seq"]).select(
        "call_id", "seq", F.md5(F.col("text_masked").cast("binary")).alias("text_masked"),
        F.md5(ST.decrypted(F.col("text_encrypted"), key).cast("binary")).alias("opened"), "hidden")


@check("g02_audited_read", f"""WITH {SQL_SEGMENTS}, n AS (SELECT conv_id AS call_id, count(s.call_id) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c
      LEFT JOIN seg s ON s.call_id = c.conv_id GROUP BY 1)
    SELECT 'reader' AS actor, 'read_transcript' AS action, call_id::VARCHAR AS call_id, 'segments=' || n || ' opened=' || n AS detail FROM n WHERE call_id % 3 <> 0""")
def g02(spark, d):
    """Audit rows of a decrypting read of all calls but deleted ones, by a job that was run twice."""
    from callward.operators.cut import scratch

    key, path = F.lit("0123456789abcdef"), scratch(spark, "audit")
    calls = table(spark, d, "conversations").select(F.col("conv_id").alias("call_id")).distinct().withColumn(
        "deleted_at", F.when(F.col("call_id") % 3 == 0, F.lit(_NOW)))
    stored = ST.stored_segments(segments(spark, d), key)
    for _ in range(2):
        W.audited_read(calls, stored, calls, key, path, "check", "reader")
    return spark.read.parquet(path).select("actor", "action", "call_id", "detail")
