"""Finished calls: segments in, events, verdicts and scores out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callward import vocab
from callward.functions.text import ActMarkers
from callward.operators import concepts, grounding, score, sequence, verdict
from callward.operators.cut import materialize
from callward.params import Lexicon


@dataclass(frozen=True)
class Analysis:
    """The tables of one analysis; each is lazy and can be written on its own."""

    calls: DataFrame
    context: DataFrame
    observations: DataFrame
    clause_events: DataFrame
    summary: DataFrame
    events: DataFrame


@dataclass(frozen=True)
class Scored(Analysis):
    partitioned: DataFrame
    assessed: DataFrame


def analyze(segments: DataFrame, lexicon: Lexicon, markers: ActMarkers = ActMarkers(),
            conjunctions: tuple[str, ...] = vocab.CONJUNCTIONS, realtime: bool = False,
            cut: bool = True) -> Analysis:
    """segments(call_id, seq, speaker, start, end, text, confidence, call_direction)."""
    sig = signal_rows(segments, lexicon, markers, conjunctions)
    return analyze_signals(materialize(sig) if cut else sig, realtime, cut)


def signal_rows(segments: DataFrame, lexicon: Lexicon, markers: ActMarkers = ActMarkers(),
                conjunctions: tuple[str, ...] = vocab.CONJUNCTIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the rules need of every utterance, whatever call or window it is looked at in.

    A projection of the segments, which streams as well; `keep` names columns to carry along.
    """
    return sequence.signals(concepts.clauses(segments, lexicon, markers, conjunctions, keep)).drop("padded")


def analyze_signals(sig: DataFrame, realtime: bool = False, cut: bool = True) -> Analysis:
    """The analysis from signal rows on; they are read several times."""
    context = sequence.in_context(sig, sequence.context_marks(sig))
    if cut:
        context = materialize(context)
    calls = verdict.call_facts(context)
    observations = sequence.first_observations(context)
    base = verdict.dedupe_events(sequence.clause_events(context))
    if cut:  # the verdicts read both, and the events again
        observations, base = materialize(observations, "observations"), materialize(base, "base")
    summary = verdict.summarize_calls(
        calls, base, sequence.call_context(context), observations, realtime)
    if cut:
        summary = materialize(summary)
    events = (
        base.unionByName(verdict.framing_events(observations, summary))
        .unionByName(verdict.protective_events(sequence.protective_rows(context), summary))
        .withColumn("segment_index", F.col("seq"))
        .withColumn("grounding_score", F.lit(1.0))
    )
    return Analysis(calls, context, observations, base, summary, events)


def score_calls(analysis: Analysis, policy: score.Policy = score.Policy(),
                events: DataFrame | None = None) -> Scored:
    """Score an analysis; `events` replaces its events, e.g. after quote grounding."""
    partitioned = score.partition_events(analysis.events if events is None else events)
    assessed = score.assess(score.score_facts(partitioned, policy), analysis.summary, policy)
    return Scored(**analysis.__dict__, partitioned=partitioned, assessed=assessed)


def score_grounded(analysis: Analysis, findings: DataFrame, segments: DataFrame,
                   policy: score.Policy = score.Policy()) -> tuple[Scored, DataFrame]:
    """Score the findings of a model instead of the analysis' own events; (scored calls, dropped findings).

    findings(call_id, quote_id, evidence, category, severity, ...): quotes are located in the transcript, their time and
    speaker are those of the place found, and what has no place is dropped, counted, and told as a disagreement.
    """
    kept, dropped = grounding.ground(findings, segments)
    kept, dropped = materialize(kept, "kept"), materialize(dropped, "dropped")
    counts = dropped.groupBy("call_id").agg(F.count("*").alias("n_dropped"))
    summary = analysis.summary.join(counts, "call_id", "left").fillna(0, ["n_dropped"])
    return score_calls(replace(analysis, summary=summary), policy, kept), dropped


def risk_scores(segments: DataFrame, lexicon: Lexicon, **kw) -> DataFrame:
    """The short way: one row per call with verdict, score, level and alert."""
    scored = score_calls(analyze(segments, lexicon, **kw))
    return scored.assessed.select(
        "call_id", "classification", "confidence", "stage", "scam_types", "tactics",
        "requested_actions", "risk_score", "risk_level", "alert_level", "disagreement",
    )
