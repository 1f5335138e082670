"""Checks of live streams: whole tables through Structured Streaming, against SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from callward import vocab as v
from callward.operators.cut import scratch
from callward.streaming import live
from checks import analysis_sql as A
from checks.common import CONJUNCTIONS, MARKERS, PROSE, check, table, turns


def landed(spark, d, end_seconds: int | None = None):
    """The conversations as messages ten seconds apart; or the rows that close every second call, much later."""
    rows = turns(spark, d).select(
        F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("bigint").alias("seq"), "speaker",
        F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), "text", "confidence",
        "call_direction", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 10).alias("ts"), F.lit(False).alias("closed"))
    if end_seconds is None:
        return rows
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("call_id", "ts", "closed")]
    ended = rows.groupBy("call_id").agg((F.max("ts") + F.make_interval(secs=F.lit(end_seconds))).alias("ts")).filter(
        F.pmod(F.crc32("call_id"), F.lit(2)) == 0)
    return ended.select("call_id", *none, "ts", F.lit(True).alias("closed")).select(*rows.columns)


@check("st01_live_stream", f"""WITH RECURSIVE {A.over_windows(v.CONTEXT_WINDOW, True)} {A.SQL_HELD},
    last AS (SELECT call_id, max(upd) AS n FROM u GROUP BY 1),
    alerts AS (SELECT call_id, upd, 'CRITICAL' AS alert_level, category AS triggered_by FROM crit
      UNION ALL SELECT call_id, upd, CASE rank WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'MONITOR' END, 'risk_score' FROM held WHERE n_crit = 0 AND rank > highest)
    SELECT CAST(call_id AS VARCHAR) AS call_id, upd, CASE WHEN upd = n THEN 'final' ELSE 'update' END AS kind, risk_score, peak, stage, deepest_stage, entered,
      n_fresh::INT AS n_fresh, all_tactics AS tactics, all_scams AS scam_types, n_updates::INT AS n_updates, n_alerts::INT AS n_alerts,
      coalesce(alert_level, 'NONE') AS alert_level, coalesce(triggered_by, '') AS triggered_by
    FROM deep JOIN last USING (call_id) LEFT JOIN alerts USING (call_id, upd)""")
def st01(spark, d):
    """All conversations as a live stream that is stopped and goes on: turns in two parts, then closing rows.

    Every second call is closed by its row, the others by silence; each is analysed anew as a whole, once.
    """
    root = scratch(spark, "live")
    arriving = f"{root}/in"
    scorer = live.LiveScorer(f"{root}/out", PROSE, MARKERS, CONJUNCTIONS, partitions=spark.sparkContext.defaultParallelism)
    rows = landed(spark, d)
    for part in (rows.filter("seq < 2"), rows.filter("seq >= 2"), landed(spark, d, 2 * live.IDLE_SECONDS)):
        part.write.mode("append").parquet(arriving)
        live.run_available(scorer, live.turn_stream(spark, arriving, 1000, "parquet"))
    return live.frames_available(scorer, spark).withColumns({c: F.array_join(c, "|") for c in ("tactics", "scam_types")})


@check("st03_event_time_stream", """WITH mark AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM events WHERE event_id % 10 <> 0),
    r AS (SELECT user_id, value, epoch_us(ts) // 3600000000 AS chunk, event_id FROM events)
    SELECT user_id AS call_id, chunk::BIGINT AS chunk, count(*) AS n FROM r, mark
    WHERE event_id % 10 <> 0 OR make_timestamp((chunk + 1) * 3600000000) > wm GROUP BY ALL""")
def st03(spark, d):
    """Hours of every user's events from a stream: a tenth comes too late unless its hour is still open, and a
    last row of no user closes the hours that are left."""
    root = scratch(spark, "slices")
    arriving, root = scratch(spark, "events"), scratch(spark, "slices")
    events = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("call_id"), F.col("event_id").cast("bigint").alias("event_id"),
        F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))").alias("ts"))
    end = events.agg((F.max("ts") + F.make_interval(days=F.lit(2))).alias("ts")).select(
        F.lit("").alias("call_id"), F.lit(-1).cast("bigint").alias("event_id"), "ts")
    stream = spark.readStream.schema(events.schema).parquet(arriving)
    for part in (events.filter("event_id % 10 <> 0"), events.filter("event_id % 10 = 0"), end):
        part.write.mode("append").parquet(arriving)
        with live.state_partitions(spark, spark.sparkContext.defaultParallelism):
            query = live.tumbling(stream, "1 hour", "2 hours").writeStream.format("parquet").option("path", f"{root}/out").option(
                "checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    out = spark.read.parquet(f"{root}/out").filter("call_id <> ''")
    return out.select(F.col("call_id").cast("bigint").alias("call_id"), F.floor(F.unix_timestamp("window.start") / 3600).alias("chunk"), "n")
