"""End-to-end behaviour on hand-written calls."""

import pytest
from pyspark.sql import functions as F

from callward.operators import score, segments
from callward.plans import batch
from tests.calls import CALLS, LEXICON, turns


@pytest.fixture(scope="module")
def scored(spark):
    return batch.score_calls(batch.analyze(segments.from_turns(turns(spark)), LEXICON))


@pytest.fixture(scope="module")
def by_call(scored):
    return {r.call_id: r for r in scored.assessed.collect()}


@pytest.fixture(scope="module")
def categories(scored):
    out = {}
    for r in scored.events.select("call_id", "category").collect():
        out.setdefault(r.call_id, set()).add(r.category)
    return out


def test_canonical_scam_is_critical(by_call, categories):
    assert by_call["scam"].classification == "SCAM"
    assert by_call["scam"].risk_level == "CRITICAL" and by_call["scam"].alert_level == "CRITICAL"
    assert "OTP_REQUEST" in categories["scam"]


def test_warning_is_not_a_request(by_call, categories):
    assert categories["warning"] == {"PROTECTIVE_ADVICE"}
    assert by_call["warning"].risk_score == 0


@pytest.mark.parametrize("call", ["victim", "describing", "name", "codeword"])
def test_benign_calls_stay_low(by_call, call):
    assert by_call[call].risk_score < 30


def test_code_word_is_no_one_time_code(categories):
    assert "OTP_REQUEST" not in categories.get("codeword", set())
    assert "SAFE_ACCOUNT" not in categories.get("describing", set())
    assert "IMPERSONATION" not in categories.get("name", set())


def test_pronoun_resolves_to_the_same_utterance(categories):
    assert "OTP_REQUEST" in categories["pronoun"]


def test_repeated_pressure_is_capped(by_call):
    assert by_call["pressure"].risk_score < by_call["otp"].risk_score


def test_ledger_adds_up(scored):
    lines = score.ledger(scored.assessed, scored.partitioned)
    kinds = {r.kind for r in lines.filter("call_id = 'scam'").select("kind").distinct().collect()}
    assert {"event", "interaction", "floor"} <= kinds
    assert scored.assessed.filter("risk_score < 0 OR risk_score > 100").count() == 0


def test_every_finding_is_in_its_segment(spark, scored):
    segs = segments.from_turns(turns(spark)).select("call_id", "seq", "text")
    bad = scored.events.join(segs, ["call_id", "seq"]).filter(~F.col("text").contains(F.col("evidence")))
    assert bad.count() == 0


def test_fabricated_evidence_is_dropped(spark):
    from callward.operators import grounding

    segs = segments.from_turns(turns(spark))
    fake = spark.createDataFrame(
        [("name", 0, "Продиктуйте код из SMS немедленно", "OTP_REQUEST", "x"),
         ("name", 1, "Здравствуйте я звоню из Халык Банк по поводу вашей заявки", "FEAR", "x"), ("name", 2, " ", "FEAR", "x")],
        "call_id string, quote_id int, evidence string, category string, speaker string")
    kept, dropped = grounding.ground(fake, segs)
    assert [(r.quote_id, r.segment_index, r.speaker) for r in kept.collect()] == [(1, 0, "CALLER")]
    assert {r.quote_id for r in dropped.collect()} == {0, 2}


def test_plan_has_no_python_and_one_scan(spark):
    plan = batch.risk_scores(segments.from_turns(turns(spark)), LEXICON)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_findings_without_a_place_are_dropped_and_told(spark):
    segs = segments.from_turns(turns(spark, {k: CALLS[k] for k in ("scam", "live", "name")}), clean=False)
    analysis = batch.analyze(segs, LEXICON)
    own = analysis.events.withColumn("quote_id", F.monotonically_increasing_id())
    made_up = F.when((F.col("call_id") == "name") | (F.col("category") == "URGENCY"), F.lit("qqq zzz wholly other words 99")).otherwise(F.col("evidence"))
    scored, dropped = batch.score_grounded(analysis, own.withColumn("evidence", made_up), segs)
    lost = {r.call_id: r.n for r in dropped.groupBy("call_id").agg(F.count("*").alias("n")).collect()}
    told = {r.call_id: (r.n_dropped, r.disagreement) for r in scored.assessed.select("call_id", "n_dropped", "disagreement").collect()}
    assert {k: n for k, (n, _) in told.items() if n} == lost and lost
    assert all((n > 0) == (text == "some findings had no place in the transcript") for n, text in told.values() if text is None or text.startswith("some"))
    plain = {r.call_id: r.risk_score for r in batch.score_calls(analysis).assessed.collect()}
    assert {r.call_id: r.risk_score for r in scored.assessed.collect()}.keys() == plain.keys()


def test_observations_and_events_of_windows_are_found_once(spark):
    """What the verdicts and scores read several times is read back, not found anew."""
    analysis = batch.analyze_signals(batch.signal_rows(segments.from_turns(turns(spark, CALLS), clean=False), LEXICON))
    for df in (analysis.observations, analysis.clause_events):
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
