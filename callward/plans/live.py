"""Replay of calls turn by turn: batch analysis of every window, then running state."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callward import vocab
from callward.functions.text import ActMarkers
from callward.operators import live
from callward.operators.cut import materialize
from callward.params import Lexicon
from callward.plans import batch
from callward.sources import writers


@dataclass(frozen=True)
class Replay:
    updates: DataFrame
    fresh: DataFrame
    alerts: DataFrame
    timeline: DataFrame


def analyze_updates(segments: DataFrame, lexicon: Lexicon, markers: ActMarkers = ActMarkers(),
                    conjunctions: tuple[str, ...] = vocab.CONJUNCTIONS, step: int = 1,
                    only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored updates, events per update); `only(call_id, upd)` restricts the updates.

    Clauses, concepts and speech acts are found once per utterance; the windows repeat their small rows.
    """
    windows = live.updates(materialize(batch.signal_rows(segments, lexicon, markers, conjunctions)), step)
    if only is not None:
        windows = windows.join(only, ["call_id", "upd"], "left_semi")
    return analyze_windows(windows)


def analyze_windows(windows: DataFrame, realtime: bool = True) -> tuple[DataFrame, DataFrame]:
    """(scored updates, events per update) of signal rows that repeat for every update they are heard in."""
    analysis = batch.analyze_signals(live.as_calls(windows), realtime)
    # the scores read the events, and the caller again
    scored = batch.score_calls(replace(analysis, events=materialize(analysis.events, "events")))
    updates = live.from_calls(scored.assessed.select(
        "call_id", "classification", "confidence", "risk_score", "risk_level", "stage", "tactics", "scam_types"))
    updates = updates.withColumnRenamed("classification", "model_classification").withColumn("n_seen", F.col("upd") + 1)
    events = live.from_calls(scored.events.select("call_id", "category", "sec", "severity", "evidence"))
    return materialize(updates), materialize(events)


def merge(updates: DataFrame, events: DataFrame, one_alert_per_update: bool = False) -> Replay:
    """Peak, labels, stage, fresh events and alerts over the updates of every call."""
    held = live.deepest_stage(live.hold_peak(updates))
    held = live.accumulate_labels(live.accumulate_labels(held, "tactics"), "scam_types")
    fresh = live.fresh_events(events)
    alerts = live.alert_stream(updates.select("call_id", "upd", "risk_score"), fresh, one_alert_per_update)
    return Replay(held, fresh, alerts, live.stage_timeline(updates.select("call_id", "upd", "stage")))


def replay(segments: DataFrame, lexicon: Lexicon, markers: ActMarkers = ActMarkers(),
           conjunctions: tuple[str, ...] = vocab.CONJUNCTIONS, step: int = 1,
           one_alert_per_update: bool = False) -> Replay:
    return merge(*analyze_updates(segments, lexicon, markers, conjunctions, step), one_alert_per_update)


def frames(result: Replay) -> DataFrame:
    """Live frames: newest fresh event and strongest alert of each update."""
    newest = result.fresh.groupBy("call_id", "upd").agg(F.max(F.struct("sec", "category", "severity", "evidence")).alias("event"))
    rank = F.expr("CASE level WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END")
    alert = result.alerts.groupBy("call_id", "upd").agg(
        F.max(F.struct(rank.alias("r"), "level", "triggered_by", "risk_score")).alias("alert")
    ).withColumn("alert", F.col("alert").dropFields("r"))
    return writers.update_frames(result.updates, newest, alert)
