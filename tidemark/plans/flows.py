"""Queries over streams of several batches, with rows that come late: timers, joins of two streams, late rows beside the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import forward
from tidemark.plans import series
from tidemark.plans import sql as Q
from tidemark.sources.bars import table
from tidemark.sources.tables import shared_path, stored
from tidemark.streaming import late, streams, timers

PARTS, DAYS, DELAY = 6, 5, "6 days"
END = "2100-01-01 00:00:00"
TTL = 6 * 3600


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _part(at: Column) -> Column:
    """Number of the five days in which a row arrives; all before the first or behind the last are in those."""
    return F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor(F.date_diff(at, F.lit("2024-01-01").cast("date")) / DAYS))).cast("int")


def _hours_after(at: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours.cast("int"), at)


def _streamed(rows: DataFrame, mark: DataFrame, name: str) -> DataFrame:
    """rows by their column part, four files each, and a last part that moves the watermark on to the end."""
    both = stored(rows.unionByName(mark.withColumn("part", F.lit(PARTS)), allowMissingColumns=True), name)
    return streams.read_files(rows.sparkSession, streams.feed(both.repartition(4), "part", PARTS + 1, name), 4)


def stream_safety_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors kill, sign-ups clear, purchases arm for six hours; events arrive up to six hours late, in seven batches."""
    event = F.when(F.col("event_type") == "error", "kill").when(F.col("event_type") == "signup", "clear").when(F.col("event_type") == "purchase", "arm").otherwise("other")
    log = _log(spark, sf_dir).select("user_id", F.col("ts").alias("at"), "event_id", event.alias("event"), _part(_hours_after(F.col("ts"), F.col("event_id") % 7)).alias("part"))
    mark = spark.range(1).select(F.lit(timers.MARK).alias("event"), F.lit(END).cast("timestamp_ntz").alias("at"))
    found = streams.collected(timers.safety_modes(_streamed(log, mark, "safety-log"), "user_id", TTL, DELAY), "safety-modes", store=streams.ROCKS)
    return found.select("user_id", V.iso_ms(F.timestamp_micros("at").cast("timestamp_ntz")).alias("at"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), "mode", "generation")


def _joined(spark: SparkSession, sf_dir: str, gaps: bool) -> DataFrame:
    """Signals' steps beside bars, both as streams, bars up to six hours late."""
    signals, bars = series._signals(spark, sf_dir)
    mark = spark.range(1).select(F.lit(END).cast("timestamp_ntz").alias("closed_at"))
    arrives = _part(_hours_after(F.col("closed_at"), F.col("idx") % 7))
    right = bars.filter("idx % 40 != 9") if gaps else bars
    wanted = forward.steps(signals, Q.SECONDS, series.HOLD).withColumn("part", _part(F.col("entry_at"))).drop("idx")
    left = _streamed(wanted, mark.withColumn("signal_id", F.lit("")), "signals")
    feed = _streamed(right.select("closed_at", "high", "low", "close", arrives.alias("part")), mark, "bars")
    return streams.collected(streams.with_paths(left, feed, DELAY), "paths").filter("signal_id != ''")


def stream_join_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forward.closed(_joined(spark, sf_dir, False).filter("there"), series.COST, series.HOLD)
    return found.select("model_id", series.stamped("entry_at"), F.col("exit_step").cast("long").alias("exit_step"), series.r(F.col("exit_close").cast("double")).alias("exit_close"), series.r("net_return").alias("net_return"))


def stream_join_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that came out of the join without a bar, by signal due on 25 January."""
    open_ = _joined(spark, sf_dir, True).filter(~F.col("there") & (F.col("due_at") <= F.lit("2024-01-25").cast("timestamp_ntz")))
    return open_.groupBy("signal_id", series.stamped("due_at")).agg(F.count("*").alias("missing"))


def _split(spark: SparkSession, sf_dir: str) -> late.LateTable:
    """Events in six batches, the third one twice; every eleventh arrives a week late, what is a day behind counts as late."""
    delay = F.when(F.col("event_id") % 11 == 0, 168).otherwise(F.col("event_id") % 7)
    own = stored(_log(spark, sf_dir).select("event_id", "ts", "value", _part(_hours_after(F.col("ts"), delay)).alias("part")), "arrivals")
    out = late.LateTable(spark, shared_path(spark, "late-table"), own.drop("part").schema, "ts", 86400)
    for number in (0, 1, 2, 2, 3, 4, 5):
        out.append(own.filter(F.col("part") == number).drop("part"), number)
    return out


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _split(spark, sf_dir)
    shown = lambda df, place: df.select("event_id", F.lit(place).alias("place"), F.col("batch").cast("long").alias("batch"))
    return shown(out.on_time(), "on_time").unionByName(shown(out.late(), "late"))


def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _split(spark, sf_dir)
    what = {"volume": F.count("*"), "largest": F.max("value")}
    return late.reopened(out.on_time(), out.late(), F.date_trunc("hour", "ts").cast("timestamp_ntz"), what)


def late_bars_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reopened(spark, sf_dir)
    return found.select(V.iso_ms("bar").alias("opened_at"), F.coalesce("first_volume", F.lit(0)).alias("first_volume"), "first_largest", "volume", "largest", "late_rows")


def late_paths_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals whose holding period has bars that late rows opened again: these are settled anew."""
    signals, _ = series._signals(spark, sf_dir)
    bars = _reopened(spark, sf_dir).select(F.timestamp_add("SECOND", F.lit(Q.SECONDS), "bar").alias("closed_at"), *[F.lit(0.0).alias(c) for c in ("high", "low", "close")])
    return forward.paths(signals, bars, Q.SECONDS, series.HOLD).groupBy("signal_id").agg(F.count("*").alias("bars"), F.min("step").cast("long").alias("first_step"))


QUERIES = {
    "stream_safety_modes": stream_safety_modes, "stream_join_settle": stream_join_settle, "stream_join_incomplete": stream_join_incomplete,
    "late_events": late_events, "late_bars_reopened": late_bars_reopened, "late_paths_reopened": late_paths_reopened,
}

_ARRIVED = """arrived AS (
  SELECT event_id, ts, value, greatest(0, least(5, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts + to_hours(CAST(CASE WHEN event_id % 11 = 0 THEN 168 ELSE event_id % 7 END AS BIGINT)) AS DATE)) / 5.0) AS BIGINT))) AS batch FROM events),
peaks AS (SELECT a.batch, (SELECT max(b.ts) FROM arrived b WHERE b.batch < a.batch) - INTERVAL '1 day' AS edge FROM (SELECT DISTINCT batch FROM arrived) a),
split AS (SELECT a.*, CASE WHEN ts < edge THEN 'late' ELSE 'on_time' END AS place FROM arrived a JOIN peaks USING (batch))"""
_REOPENED = f"""{_ARRIVED},
reopened AS (
  SELECT date_trunc('hour', ts) AS bar, count(*) FILTER (place = 'on_time') AS first_volume, max(value) FILTER (place = 'on_time') AS first_largest, count(*) AS volume, max(value) AS largest, count(*) FILTER (place = 'late') AS late_rows
  FROM split GROUP BY 1 HAVING count(*) FILTER (place = 'late') > 0)"""

ORACLES = {
    "stream_safety_modes": f"""WITH log AS (
  SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'kill' WHEN 'signup' THEN 'clear' WHEN 'purchase' THEN 'arm' ELSE 'other' END AS event FROM events),
seen AS (
  SELECT *, max(ts) FILTER (event = 'kill') OVER w AS k, max(ts) FILTER (event = 'clear') OVER w AS c, max(ts) FILTER (event = 'arm') OVER w AS a, count(*) FILTER (event = 'kill') OVER w AS generation,
    lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next
  FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
modes AS (
  SELECT *, a + INTERVAL '6 hours' AS until, CASE WHEN k IS NOT NULL AND (c IS NULL OR c < k) THEN 'killed' WHEN a + INTERVAL '6 hours' > ts AND (k IS NULL OR a > k) THEN 'armed' ELSE 'observe' END AS mode FROM seen)
SELECT user_id, {Q.stamp('ts')} AS at, event_id, mode, generation FROM modes
UNION ALL SELECT user_id, {Q.stamp('until')}, -1, 'observe', generation FROM modes WHERE mode = 'armed' AND (next IS NULL OR next >= until)""",
    "stream_join_settle": series.ORACLES["shadow_settle"],
    "stream_join_incomplete": series.ORACLES["shadow_incomplete"],
    "late_events": f"WITH {_ARRIVED} SELECT event_id, place, batch FROM split",
    "late_bars_reopened": f"WITH {_REOPENED} SELECT {Q.stamp('bar')} AS opened_at, first_volume, first_largest, volume, largest, late_rows FROM reopened",
    "late_paths_reopened": f"""WITH RECURSIVE {series._EMIT}, {_REOPENED}
SELECT g.signal_id, count(*) AS bars, min(CAST(date_diff('hour', g.entry_at, r.bar) + 1 AS BIGINT)) AS first_step
FROM signals g JOIN reopened r ON r.bar + INTERVAL '1 hour' > g.entry_at AND r.bar + INTERVAL '1 hour' <= g.due_at GROUP BY g.signal_id""",
}
