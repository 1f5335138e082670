"""Live calls on Structured Streaming.

Turns arrive as files or messages keyed by call.  Three steps, each reading only what is new:

1. `utterances` and `batch.signal_rows`, projections in the JVM: cleanup, clauses, concepts, speech acts.
2. `CallContext`, a stateful operator: numbers and times the turns of a call, holds the last forty
   and tells in which windows they are heard, which the JVM then repeats for every new turn; when the
   call closes or falls silent, it gives all of them back once for the full analysis.
3. `LiveScorer`, a foreachBatch function: the rules of the batch plan over these windows.

`monitor` then holds peak, stages, labels, seen events and alert level per call, from the updates that
step 3 writes.  Nothing that has landed is read again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callward import vocab
from callward.functions import text as T
from callward.operators.concepts import position
from callward.operators.cut import materialize
from callward.params import Lexicon
from callward.plans import batch
from callward.plans.live import analyze_windows

TURN = ("call_id string, seq bigint, speaker string, start double, end double, text string, "
        "confidence double, call_direction string, ts timestamp, closed boolean")
UPDATE = ("call_id string, upd bigint, kind string, risk_score int, stage string, tactics array<string>, scam_types array<string>, "
          "events array<struct<category:string,sec:bigint,severity:string,quote:string>>, ts timestamp")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_SECONDS = 1800
CLOSING = 2**62  # sorts the closing row of a call behind its turns


def turn_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, fmt: str = "json") -> DataFrame:
    """A folder of turn files as a stream; a finished call is replayed the same way."""
    return spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def deduplicated(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop re-sent turns within the watermark."""
    return turns.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["call_id", "seq"])


def tumbling(turns: DataFrame, width: str = "8 seconds", delay: str | None = "1 minute") -> DataFrame:
    """Turns per call and time slice; a slice is emitted once the watermark passes it.

    `delay` is None for a stream that has its watermark already.
    """
    marked = turns if delay is None else turns.withWatermark("ts", delay)
    return marked.groupBy("call_id", F.window("ts", width)).agg(F.count("*").alias("n"))


# --- windows -----------------------------------------------------------------------------


def utterances(turns: DataFrame, clean: bool = False, stems: tuple[str, ...] = ()) -> DataFrame:
    """Turns with text, cleaned if asked for, and the closing rows; without a number a turn goes by its time."""
    rows = turns.withColumns({
        "closed": F.coalesce("closed", F.lit(False)), "text": T.strip(F.coalesce("text", F.lit(""))),
    }).filter("closed OR text <> ''").select(
        "call_id", F.when(F.col("closed"), F.lit(CLOSING)).otherwise(F.coalesce("seq", F.unix_millis("ts"))).alias("seq"),
        F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), "start", "end", "text",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))).alias("confidence"),
        F.coalesce("call_direction", F.lit("unknown")).alias("call_direction"), "ts", F.unix_micros("ts").alias("us"), "closed",
        F.length("text").alias("n_chars"), F.xxhash64("text").alias("body"))
    return T.normalize(rows, "text", stems).drop("text").withColumnRenamed("text_clean", "text") if clean else rows


class CallContext(StatefulProcessor):
    """Signal rows of new turns in; out come turns, each with the updates in whose windows it is heard.

    The columns that the rules read pass through as text; a row that comes out is one turn with the texts of its
    signal rows and a range of updates, however many windows it lies in.  A turn that was sent again, or lies before
    the window, is given as `late` (update -1) and changes nothing.  Turns are numbered in the order of `seq` within a
    micro-batch, then of arrival.  A missing start follows the clock of the call: the given end of the turn before, or
    its start and a cadence.  A call ends with its closing row, or when the watermark is `idle` seconds past its last
    turn; it then gives all its turns once as `final`, as the update after the last.  After a closing row later turns
    are late for as long; a call that speaks again after a silence begins anew.

    State per call: counters, the window as one value, and a list that grows with the live call and is
    gone with it.  A key's rows of one micro-batch, and the turns of a call that ends, are held in memory.
    """

    INPUT = ("call_id", "seq", "clause_ix", "start", "end", "ts", "us", "closed", "n_chars", "body", "signal")
    OUTPUT = "call_id string, seq bigint, start double, end double, signals array<string>, upd bigint, until bigint, kind string"
    ROW = Row("call_id", "seq", "start", "end", "signals", "upd", "until", "kind")

    def __init__(self, window: int = vocab.CONTEXT_WINDOW, idle: int = IDLE_SECONDS, cadence: float = 6.0):
        self.window, self.idle, self.cadence = window, idle, cadence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "n bigint, clock double, last_ms bigint, closed boolean")
        self.recent = handle.getValueState("recent", "turns string")
        self.whole = handle.getListState("whole", "turn string")

    def _turns(self, rows: Iterator[Row]) -> tuple[list[tuple[int, list[Row]]], bool, int]:
        """(number and rows of each turn, whether the call closes, its newest time in milliseconds)."""
        found: dict[int, dict[int, Row]] = {}
        bodies: dict[int, int] = {}
        closes, newest = False, None
        for row in rows:
            if row.us is not None and (newest is None or row.us > newest):
                newest = row.us
            if row.closed:
                closes = True
            # of a number that was sent with several texts the first one counts
            elif row.seq is not None and bodies.setdefault(row.seq, row.body) == row.body:
                found.setdefault(row.seq, {}).setdefault(row.clause_ix, row)
        turns = [(number, [own[ix] for ix in sorted(own)]) for number, own in sorted(found.items())]
        return turns, closes, 0 if newest is None else newest // 1000

    def _timed(self, start: float | None, end: float | None, chars: int, clock: float) -> tuple[float, float, float]:
        """When a turn begins and ends in the call, and when the next turn begins."""
        speaking = max(2.0, min(9.0, chars / 14.0))
        begins = clock if start is None else start
        after = begins + max(self.cadence, speaking + 0.6) if end is None else end + max(self.cadence - speaking, 0.6)
        return begins, max(begins, begins + speaking if end is None else end), after

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head = self.head.get()
        n, clock, last, closed = head or (0, 1.5, None, False)
        turns, closes, newest = self._turns(rows)
        # [number, [place in the call, start, end, signals]] of the turns in the window
        held = json.loads(self.recent.get()[0]) if n and not closed else []
        known = {number for number, _ in held}
        begun, heard, fresh = n, list(held), []
        for number, own in turns:
            start, end, signals = _number(own[0].start), _number(own[0].end), [row.signal for row in own]
            if closed or number in known or (len(held) == self.window and number < min(known)):
                yield self.ROW(key[0], number, start, end, signals, -1, -1, "late")
                continue
            begins, ends, clock = self._timed(start, end, own[0].n_chars, clock)
            turn = [n, begins, ends, signals]
            fresh.append((json.dumps(turn),))
            held.append([number, turn])
            heard.append([number, turn])
            known.add(number)
            if len(held) > self.window:
                known.discard(held.pop(0)[0])
            n += 1
        for _, (k, begins, ends, signals) in heard:
            first, until = max(k, begun), min(k + self.window, n) - 1
            if first <= until:
                yield self.ROW(key[0], k, begins, ends, signals, first, until, "update")
        if closes and not closed:
            yield from self._final(key, n, begun > 0, [turn for turn, in fresh])
            closed = True
        elif fresh:
            self.whole.appendList(fresh)
            self.recent.update((json.dumps(held),))
        due = max(last or 0, newest)
        self.head.update((n, clock, due, closed))
        if due != last:
            # a call that is known has one timer, of its last turn
            if last is not None:
                self.handle.deleteTimer(last + 1000 * self.idle)
            self.handle.registerTimer(due + 1000 * self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head = self.head.get()
        if head:
            n, _, _, closed = head
            if not closed:
                yield from self._final(key, n, n > 0)
            self.head.clear()

    def _final(self, key: tuple, n: int, stored: bool, fresh: Sequence[str] = ()) -> Iterator[Row]:
        """All turns of the call, those in the state and the fresh ones; they leave the state."""
        for turn in chain((turn for turn, in self.whole.get()) if stored else (), fresh):
            yield self.ROW(key[0], *json.loads(turn), n, n, "final")
        if stored:
            self.whole.clear()
            self.recent.clear()

    def close(self) -> None:
        pass


def _number(value: float | None) -> float | None:
    return None if value is None or value != value else value


def windows(turns: DataFrame, lexicon: Lexicon, markers: T.ActMarkers = T.ActMarkers(),
            conjunctions: tuple[str, ...] = vocab.CONJUNCTIONS, clean: bool = False, window: int = vocab.CONTEXT_WINDOW,
            idle: int = IDLE_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Stream of turns -> stream of window rows: call_id, the signal columns, upd, kind (update, final, late)."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spoken = utterances(turns.withWatermark("ts", delay), clean, lexicon.protected_stems() if clean else ())
    sig = batch.signal_rows(spoken, lexicon, markers, conjunctions, keep=("ts", "us", "closed", "n_chars", "body"))
    kept = [f.name for f in sig.schema.fields if f.name not in ("call_id", "closed", "n_chars", "body", "ts")]
    carried = Ty.StructType([f for f in sig.schema.fields if f.name in kept and f.name not in ("seq", "pos", "start", "end")])
    heard = sig.withColumn("signal", F.to_json(F.struct(*carried.names))).select(*CallContext.INPUT).groupBy("call_id").transformWithState(
        statefulProcessor=CallContext(window, idle), outputStructType=CallContext.OUTPUT, outputMode="Append", timeMode="EventTime")
    rows = heard.withColumn("signals", F.transform("signals", lambda x: F.from_json(x, carried)))
    rows = rows.withColumn("upd", F.explode(F.sequence("upd", "until"))).select("*", F.inline("signals"))
    return rows.withColumn("pos", position(F.col("seq"), F.col("clause_ix"))).select("call_id", *kept, "upd", "kind")


@contextmanager
def state_partitions(spark: SparkSession, n: int | None) -> Iterator[None]:
    """A query started within deals its state to n partitions; it keeps them for good."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if n:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# --- updates -----------------------------------------------------------------------------


@dataclass(frozen=True)
class LiveScorer:
    """foreachBatch function: the rules over the windows of a micro-batch.

    `root` is a shared folder.  Updates, and late rows, are written under the batch number and overwritten
    when Spark repeats a batch, so a restart neither loses nor doubles rows.
    """

    root: str
    lexicon: Lexicon
    markers: T.ActMarkers = field(default_factory=T.ActMarkers)
    conjunctions: tuple[str, ...] = vocab.CONJUNCTIONS
    clean: bool = False
    window: int = vocab.CONTEXT_WINDOW
    idle: int = IDLE_SECONDS
    delay: str = "1 minute"
    partitions: int | None = None  # of the state; the session's shuffle partitions where unset

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        rows = materialize(rows, "windows")  # the stateful operator runs once
        for kind, realtime in (("update", True), ("final", False)):
            own = rows.filter(F.col("kind") == kind).drop("kind")
            if own.isEmpty():
                continue
            updates, events = analyze_windows(own, realtime)
            # events of one window, or of one call at its end
            listed = events.groupBy("call_id", "upd").agg(F.collect_list(F.struct(
                "category", "sec", "severity", T.quote_canon(F.col("evidence")).alias("quote"))).alias("events"))
            newest = own.groupBy("call_id", "upd").agg(F.timestamp_micros(F.max("us")).alias("ts"))
            self._write(updates.join(listed, ["call_id", "upd"], "left").join(newest, ["call_id", "upd"]).select(
                "call_id", "upd", F.lit(kind).alias("kind"), "risk_score", "stage", "tactics", "scam_types", "events", "ts"),
                f"updates/batch={batch_id}/part={kind}")
        late = rows.filter("kind = 'late' AND clause_ix = 0").select("call_id", "seq", "us")
        self._write(late, f"late/batch={batch_id}")

    def _write(self, df: DataFrame, place: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{place}")

    def start(self, turns: DataFrame, **trigger):
        stream = windows(turns, self.lexicon, self.markers, self.conjunctions, self.clean, self.window, self.idle, self.delay)
        with state_partitions(turns.sparkSession, self.partitions):
            return stream.writeStream.foreachBatch(self).option(
                "checkpointLocation", f"{self.root}/_score").trigger(**trigger).start()

    def updates(self, spark: SparkSession) -> DataFrame:
        """What has been written so far."""
        return spark.read.schema(UPDATE).parquet(f"{self.root}/updates").drop("batch", "part")

    def update_stream(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.schema(UPDATE).parquet(f"{self.root}/updates").drop("batch", "part")


class Monitor(StatefulProcessor):
    """Per call: peak score, stages, labels, events already seen, alert level, numbers of updates and alerts.

    A critical harmful category alerts at once and once; score alerts only escalate.  The final update of a call
    ends its state.
    """

    OUTPUT = ("call_id string, upd bigint, kind string, risk_score int, peak int, stage string, deepest_stage string, entered boolean, "
              "n_fresh int, tactics array<string>, scam_types array<string>, n_updates int, n_alerts int, alert_level string, triggered_by string")
    ROW = Row(*(c.split(" ")[0] for c in OUTPUT.split(", ")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState(
            "held", "peak int, depth int, highest int, before string, entered int, n_updates int, n_alerts int, tactics string, scam_types string")
        self.seen = handle.getMapState("seen", "category string, sec bigint, quote string", "upd bigint")
        self.alerted = handle.getMapState("alerted", "category string", "upd bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = {d: s for s, d in vocab.STAGE_DEPTH.items()}
        levels = {r: name for name, r in vocab.ALERT_ORDER.items()}
        state = self.held.get()
        peak, depth, highest, before, entered, n_updates, n_alerts, tactics, scams = state or (0, 0, 0, "", -1, 0, 0, "[]", "[]")
        tactics, scams = json.loads(tactics), json.loads(scams)
        # what is looked up in the state once, and what is new to it
        known: dict[tuple, bool] = {}
        seen: dict[tuple, int] = {}
        alerted: dict[tuple, int] = {}
        ended = False

        def is_new(held, new: dict[tuple, int], entry: tuple, upd: int) -> bool:
            if entry in known:
                return False
            known[entry] = True
            if state and held.containsKey(entry):
                return False
            new[entry] = upd
            return True

        for row in sorted(rows, key=lambda row: row.upd):
            score, now = row.risk_score, vocab.STAGE_DEPTH.get(row.stage, 0)
            peak, depth, n_updates = max(peak, score), max(depth, now), n_updates + 1
            # a stage is entered when it isn't that of the update before, nor one behind a stage entered earlier
            enters = row.stage != before and now >= entered
            if row.stage != before:
                entered = max(entered, now)
            before = row.stage
            for labels, new in ((tactics, row.tactics), (scams, row.scam_types)):
                labels += [x for x in new or [] if x not in labels]
            fresh, critical = 0, []
            for e in sorted(row.events or [], key=lambda e: (e["sec"], e["category"])):
                if not is_new(self.seen, seen, (e["category"], e["sec"], e["quote"]), row.upd):
                    continue
                fresh += 1
                harmful = e["category"] in vocab.HARMFUL and e["severity"] == "CRITICAL"
                if harmful and is_new(self.alerted, alerted, (e["category"],), row.upd):
                    critical.append(e["category"])
            rank = max((vocab.ALERT_ORDER[n] for n, at in vocab.ALERT_THRESHOLDS.items() if score >= at), default=0)
            alerts = [("CRITICAL", c) for c in critical] or [(levels[rank], "risk_score")] * (rank > highest)
            n_alerts += len(alerts)
            highest = vocab.ALERT_ORDER["CRITICAL"] if critical else max(highest, rank)
            base = (key[0], row.upd, row.kind, score, peak, row.stage, names[depth], enters, fresh, list(tactics), list(scams), n_updates, n_alerts)
            for alert in alerts or [("NONE", "")]:
                yield self.ROW(*base, *alert)
            ended = row.kind == "final"
        if not ended:
            for held, new in ((self.seen, seen), (self.alerted, alerted)):
                for entry, upd in new.items():
                    held.updateValue(entry, (upd,))
            self.held.update((peak, depth, highest, before, entered, n_updates, n_alerts, json.dumps(tactics), json.dumps(scams)))
        elif state:
            for held in (self.held, self.seen, self.alerted):
                held.clear()

    def close(self) -> None:
        pass


def monitor(updates: DataFrame) -> DataFrame:
    """Stream of scored updates -> stream of live frames with held state."""
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return updates.drop("ts").groupBy("call_id").transformWithState(
        statefulProcessor=Monitor(), outputStructType=Monitor.OUTPUT, outputMode="Append", timeMode="None")


def run_available(scorer: LiveScorer, turns: DataFrame) -> int:
    """Handle what has arrived, and end; the number of rows that were read."""
    query = scorer.start(turns, availableNow=True)
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def frames_available(scorer: LiveScorer, spark: SparkSession) -> DataFrame:
    """Live frames of what the scorer has written, handled to the end; frames of earlier runs are kept."""
    with state_partitions(spark, scorer.partitions):
        query = monitor(scorer.update_stream(spark)).writeStream.format("parquet").option("path", f"{scorer.root}/frames").option(
            "checkpointLocation", f"{scorer.root}/_monitor").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(Monitor.OUTPUT).parquet(f"{scorer.root}/frames")
