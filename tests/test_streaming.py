"""Streams against the batch replay of the same calls."""

import json
from types import SimpleNamespace

from pyspark.sql import functions as F

from callward.functions.text import ActMarkers
from callward.operators import segments
from callward.plans import batch, live
from callward.streaming import live as stream
from tests.calls import CALLS, LEXICON, turns

USED = {k: CALLS[k] for k in ("scam", "live")}


def _segments(spark):
    return segments.from_turns(turns(spark, USED), clean=False)


TURN_COLUMNS = [c.split(" ")[0] for c in stream.TURN.split(", ")]


def _land(spark, folder, rows):
    """rows: (call, seq, speaker, start, end, text, second, closed)"""
    df = spark.createDataFrame(rows, "call_id string, seq bigint, speaker string, start double, end double, text string, at double, closed boolean")
    df.withColumns({"confidence": F.lit(0.9), "call_direction": F.lit("outbound"), "ts": F.timestamp_seconds(F.col("at") + 1_700_000_000)}).select(
        *TURN_COLUMNS).coalesce(1).write.mode("append").json(folder)


def _said(call, turns, since=0, end=None, at=0):
    return [(call, k, s, None, None, t, at + 10.0 * k, False) for k, (s, t) in enumerate(turns) if k >= since and (end is None or k < end)]


def _closing(call, second):
    return [(call, None, None, None, None, None, second, True)]


def test_stream_equals_replay_across_a_restart(spark, tmp_path):
    """Turns sent again, late, blank; one call closed, one fallen silent; the second run goes on from the state."""
    folder, calls = str(tmp_path / "in"), {k: [t[-2:] for t in v[1]] for k, v in USED.items()}
    (tmp_path / "in").mkdir()
    scorer = stream.LiveScorer(str(tmp_path / "out"), LEXICON, ActMarkers(), partitions=2)
    source = stream.turn_stream(spark, folder, 10)
    first = [r for k, v in calls.items() for r in _said(k, v, end=2)] + _said("scam", calls["scam"], end=1)
    _land(spark, folder, first + [("scam", 50, "CALLER", None, None, " ", 5.0, False)])
    assert stream.run_available(scorer, source) == len(first) + 1
    second = [r for k, v in calls.items() for r in _said(k, v, since=1)]
    _land(spark, folder, second)
    assert stream.run_available(scorer, source) == len(second)  # nothing of the first part is read again
    third = _closing("scam", 900.0) + [("scam", 99, "CALLER", None, None, "too late", 901.0, False)]
    _land(spark, folder, third)
    stream.run_available(scorer, source)
    _land(spark, folder, [("scam", 98, "CALLER", None, None, "much too late", 902.0, False), *_closing("clock", 9000.0)])
    stream.run_available(scorer, source)

    rows = [(k, n, s, t) for k, v in calls.items() for n, (s, t) in enumerate(v)] + [("scam", 99, "CALLER", "too late")]
    segs = segments.from_turns(spark.createDataFrame(rows, "call_id string, turn long, speaker string, text string").withColumns(
        {"confidence": F.lit(0.9), "call_direction": F.lit("outbound")}), clean=False)
    cols = ("call_id", "upd", "risk_score", "stage")
    got = scorer.updates(spark)
    want = live.analyze_updates(segs, LEXICON)[0]
    pick = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert pick(got.filter("kind = 'update'")) == pick(want)
    full = batch.score_calls(batch.analyze(segs, LEXICON)).assessed
    assert sorted((r.call_id, r.risk_score, r.stage) for r in got.filter("kind = 'final'").collect()) == sorted(
        (r.call_id, r.risk_score, r.stage) for r in full.collect())
    late = spark.read.parquet(f"{scorer.root}/late")
    assert sorted((r.call_id, r.seq) for r in late.select("call_id", "seq").collect()) == [
        ("live", 1), ("scam", 1), ("scam", 98)]

    frames = stream.frames_available(scorer, spark)
    held = live.merge(*live.analyze_updates(segs, LEXICON))
    ups = frames.filter("kind = 'update'")
    assert sorted({(r.call_id, r.upd, r.peak, r.deepest_stage, tuple(r.tactics)) for r in ups.collect()}) == sorted(
        (r.call_id, r.upd, r.peak, r.deepest_stage, tuple(r.all_tactics)) for r in held.updates.collect())
    assert {(r.call_id, r.upd) for r in ups.filter("entered").collect()} == {(r.call_id, r.upd) for r in held.timeline.collect()}
    assert sorted((r.call_id, r.upd, r.alert_level, r.triggered_by) for r in ups.filter("alert_level <> 'NONE'").collect()) == sorted(
        (r.call_id, r.upd, r.level, r.triggered_by) for r in held.alerts.collect())
    assert {r.call_id: r["count"] for r in frames.filter("kind = 'final'").groupBy("call_id").agg(
        F.count_distinct("upd").alias("count")).collect()} == {k: 1 for k in USED}
    assert stream.frames_available(scorer, spark).count() == frames.count()


def test_clock_of_a_live_call_is_that_of_the_batch(spark, tmp_path):
    """Missing starts and ends are filled in as by the whole call at once, across micro-batches."""
    (tmp_path / "in").mkdir()
    times = [(None, None), (None, 11.0), (None, None), (40.0, None), (None, None), (50.5, 52.0), (None, None)]
    rows = [("c", k, "CALLER", s, e, "word " * (3 + 9 * k), 10.0 * k, False) for k, (s, e) in enumerate(times)]
    scorer = stream.LiveScorer(str(tmp_path / "out"), LEXICON, partitions=1, window=4)
    found = []

    def keep(df, _):
        found.extend((r.seq, r.start, r.end, r.upd) for r in df.collect() if r.kind == "update")

    source = stream.windows(stream.turn_stream(spark, str(tmp_path / "in"), 1), LEXICON, window=4)
    for part in (rows[:3], rows[3:]):
        _land(spark, str(tmp_path / "in"), part)
        with stream.state_partitions(spark, 1):
            source.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    turns_ = spark.createDataFrame([(c, k, s, a, e, t) for c, k, s, a, e, t, _, _ in rows],
                                   "call_id string, turn long, speaker string, start double, end double, text string")
    want = {r.seq: (r.start, r.end) for r in segments.from_turns(turns_, clean=False).collect()}
    assert {(s, u) for s, _, _, u in found} == {(s, u) for u in range(7) for s in range(max(0, u - 3), u + 1)}
    assert all(abs(a - want[s][0]) < 1e-9 and abs(e - want[s][1]) < 1e-9 for s, a, e, _ in found)
    assert scorer.window == 4


def test_monitor_state(spark, tmp_path):
    event = lambda c, s, sev: (c, s, sev, f"{c} {s}")
    rows = [("a", 0, "update", 35, "FEAR_ESCALATION", ["FEAR"], [], [event("FEAR", 1, "MEDIUM")]),
            ("a", 1, "update", 80, "CREDENTIAL_EXTRACTION", ["OTP"], ["X"], [event("FEAR", 1, "MEDIUM"), event("OTP_REQUEST", 9, "CRITICAL")]),
            ("a", 2, "update", 20, "INTRODUCTION", [], None, [event("OTP_REQUEST", 9, "CRITICAL")]),
            ("a", 3, "final", 81, "CREDENTIAL_EXTRACTION", [], [], None), ("b", 0, "update", 65, "UNKNOWN", None, ["Y"], None)]
    df = spark.createDataFrame(rows, stream.UPDATE.replace(", ts timestamp", "")).withColumn("ts", F.current_timestamp())
    df.coalesce(1).write.parquet(str(tmp_path / "updates" / "batch=0" / "part=update"))
    scorer = stream.LiveScorer(str(tmp_path), LEXICON, partitions=1)
    got = sorted((r.call_id, r.upd, r.peak, r.deepest_stage, r.entered, r.n_fresh, "|".join(r.tactics), "|".join(r.scam_types), r.n_alerts,
                  r.alert_level, r.triggered_by) for r in stream.frames_available(scorer, spark).collect())
    assert got == [("a", 0, 35, "FEAR_ESCALATION", True, 1, "FEAR", "", 1, "MONITOR", "risk_score"),
                   ("a", 1, 80, "CREDENTIAL_EXTRACTION", True, 1, "FEAR|OTP", "X", 2, "CRITICAL", "OTP_REQUEST"),
                   ("a", 2, 80, "CREDENTIAL_EXTRACTION", False, 0, "FEAR|OTP", "X", 2, "NONE", ""),
                   ("a", 3, 81, "CREDENTIAL_EXTRACTION", True, 0, "FEAR|OTP", "X", 2, "NONE", ""),
                   ("b", 0, 65, "UNKNOWN", True, 0, "", "Y", 1, "WARNING", "risk_score")]


def test_replay_holds_the_peak_and_moves_forward(spark):
    out = live.replay(_segments(spark), LEXICON)
    rows = sorted((r.call_id, r.upd, r.peak) for r in out.updates.collect())
    for call in USED:
        peaks = [p for c, _, p in rows if c == call]
        assert peaks == sorted(peaks) and peaks[-1] >= 60
    last = out.timeline.groupBy("call_id").agg(F.max_by("stage", "upd").alias("s")).collect()
    assert {r.s for r in last} <= {"CREDENTIAL_EXTRACTION", "MONEY_TRANSFER", "PAYMENT"}


def test_tumbling_slices(spark, tmp_path):
    rows = _segments(spark).withColumn("ts", F.timestamp_seconds(F.col("start"))).select(
        "call_id", "seq", "speaker", "start", "end", "text", "confidence", "call_direction", "ts", F.lit(False).alias("closed"))
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    q = stream.tumbling(stream.deduplicated(stream.turn_stream(spark, str(tmp_path / "in")), "0 seconds"), "8 seconds", None)
    run = q.writeStream.format("memory").queryName("slices").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    total = spark.table("slices").agg(F.sum("n")).first()[0]
    assert 0 < total <= sum(len(t) for _, t in USED.values())


class _Held:
    """Stands for value, list and map states and the timers; counts what is asked."""

    def __init__(self):
        self.value, self.items, self.timers, self.asked = None, [], [], 0

    def getValueState(self, name, *schema):
        return _Held()

    getListState = getMapState = getValueState

    def get(self):
        return list(self.items) or self.value

    def update(self, value):
        self.value = value

    def appendList(self, items):
        self.items += items

    def clear(self):
        self.value, self.items = None, []

    def containsKey(self, key):
        self.asked += 1
        return key in dict(self.items)

    def updateValue(self, key, value):
        self.items.append((key, value))

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_turn_leaves_the_state_operator_once():
    """A row per turn and micro-batch with its range of windows, not one per window; the call has one timer."""
    context, handle = stream.CallContext(window=3, idle=60), _Held()
    context.init(handle)
    clause = lambda k, ix: SimpleNamespace(
        seq=k, clause_ix=ix, start=None, end=None, us=k * 1_000_000, closed=False, n_chars=10, body=k, signal=json.dumps([k, ix]))
    said = lambda turns: [clause(k, ix) for k in turns for ix in (1, 0)]
    place = lambda rows: [(r.seq, r.upd, r.until, r.kind, len(r.signals)) for r in rows]
    first = list(context.handleInputRows(("c",), iter(said(range(5))), None))
    assert place(first) == [(k, k, min(k + 2, 4), "update", 2) for k in range(5)]
    assert [json.loads(x) for x in first[0].signals] == [[0, 0], [0, 1]]
    second = list(context.handleInputRows(("c",), iter(said([1, 5])), None))
    assert place(second) == [(1, -1, -1, "late", 2), (3, 5, 5, "update", 2), (4, 5, 5, "update", 2), (5, 5, 5, "update", 2)]
    assert handle.timers == [65_000]
    assert place(context.handleExpiredTimer(("c",), None, None)) == [(k, 6, 6, "final", 2) for k in range(6)]
    assert context.whole.get() is None and context.recent.get() is None and context.head.get() is None


def test_monitor_asks_the_state_once_for_an_event():
    monitor = stream.Monitor()
    monitor.init(_Held())
    event = {"category": "OTP_REQUEST", "sec": 9, "severity": "CRITICAL", "quote": "q"}
    update = lambda n: SimpleNamespace(
        upd=n, kind="update", risk_score=80, stage="UNKNOWN", tactics=None, scam_types=[], events=[event, event])
    fresh = [r.n_fresh for n in (0, 50) for r in monitor.handleInputRows(("c",), iter([update(n + k) for k in (2, 0, 1)]), None)]
    assert fresh == [1, 0, 0, 0, 0, 0] and monitor.seen.asked == 1
