"""Bars: from ticks, and from raw nine-field candle rows.

A bar row is opened_at, closed_at (times without zone), open, high, low, close, volume (doubles). Series may be split
by key columns (an instrument, say): every function that looks along time takes them as `by`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V

BASE_PRICE = "20000.00"
TIME_CHUNK_MS = 30 * 86_400_000
CANDLE_FIELDS = 9
BAR_MS = 300_000
#: Bars before the first one with all features, and one.
LEAST_BARS = 49
CLOSE_TOLERANCE_MS = 2_000
BAR_COLUMNS = ["opened_at", "closed_at", "open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def before(rows: DataFrame, value: str, order: Sequence[str], chunk: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with column name: the sum of value over all earlier rows of the series.

    Rows are summed by chunk, an expression that rises with the order; only the chunks' totals are put in one order.
    So no task sorts a whole series, and what it does sort grows with its length in time, not with its rows.
    """
    keyed = rows.withColumn("__chunk", chunk)
    totals = keyed.groupBy(*by, "__chunk").agg(F.sum(value).alias("__total"))
    earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "__chunk", F.sum("__total").over(earlier).alias("__start"))
    inside = Window.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    summed = keyed.withColumn("__inside", F.sum(value).over(inside))
    return summed.join(starts, [*by, "__chunk"]).withColumn(name, F.coalesce("__start", zero) + F.coalesce("__inside", zero)).drop("__chunk", "__start", "__inside")


def time_chunk(column: str) -> Column:
    return F.floor(V.epoch_ms(column) / TIME_CHUNK_MS)


def ticks(events: DataFrame) -> DataFrame:
    """Events as steps of a price walk: at, tick_id, step. Purchases and sign-ups go up, views and errors down."""
    value = F.col("value").cast("decimal(12,2)")
    up, down = F.col("event_type").isin("signup", "purchase"), F.col("event_type").isin("error", "view")
    return events.select(F.col("ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("tick_id"), F.when(up, value).when(down, -value).otherwise(F.lit(0).cast("decimal(12,2)")).alias("step"))


def bars_from_ticks(steps: DataFrame, seconds: int, base: str = BASE_PRICE) -> DataFrame:
    """Bars of a price that starts at base and moves by every step; volume counts ticks.

    One shuffle by bar does the walk within bars and their summary; where a bar starts comes from the sums of bars.
    """
    width = F.window("at", f"{seconds} seconds")["start"]
    opened = steps.withColumn("opened_at", width)
    inside = Window.partitionBy("opened_at").orderBy("at", "tick_id").rowsBetween(Window.unboundedPreceding, 0)
    walk = opened.withColumn("run", F.sum("step").over(inside))
    place = F.struct("at", "tick_id")
    bars = walk.groupBy("opened_at").agg(F.min_by("run", place).alias("open"), F.max("run").alias("high"), F.min("run").alias("low"), F.max_by("run", place).alias("close"), F.sum("step").alias("total"), F.count("*").alias("volume"))
    started = before(bars, "total", ["opened_at"], time_chunk("opened_at"), "start")
    level = F.lit(base).cast("decimal(12,2)") + F.col("start")
    return started.select("opened_at", F.timestamp_add("SECOND", F.lit(seconds), "opened_at").alias("closed_at"), *[(level + F.col(c)).cast("double").alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("double").alias("volume"))


def indexed(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """bars with idx: their place in the series from 0, counted by chunks of time."""
    return before(bars.withColumn("__one", F.lit(1)), "__one", ["opened_at"], time_chunk("opened_at"), "idx", by).drop("__one")


def raw_candles(bars: DataFrame) -> DataFrame:
    """Bars in raw form: one array of nine strings a bar, the last one telling whether the bar is complete."""
    number = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    zero = F.lit("0")
    return bars.select(F.array(V.epoch_ms("opened_at").cast("string"), *[number(c) for c in ("open", "high", "low", "close", "volume")], zero, zero, F.lit("1")).alias("fields"))


def well_formed(raw: DataFrame) -> DataFrame:
    """Rows that are wide enough to be read; a data set that has any of another width is not valid: see violations."""
    return raw.filter(F.size("fields") >= CANDLE_FIELDS)


def confirmed(raw: DataFrame) -> DataFrame:
    """Complete bars only."""
    return well_formed(raw).filter(F.element_at("fields", CANDLE_FIELDS) == "1")


def parsed(raw: DataFrame, bar_ms: int = BAR_MS, above: float | None = 0) -> DataFrame:
    """Raw rows as bars; a field that is no finite number (or no price larger than above, if given) becomes null."""
    field = lambda k: F.get("fields", F.lit(k))
    ms = F.when(field(0).rlike(r"^\d+$"), field(0).try_cast("bigint"))
    opened = F.when(ms > 0, V.from_ms(ms))
    prices = [V.finite_number(field(k), above).alias(c) for k, c in enumerate(("open", "high", "low", "close"), 1)]
    return raw.select(opened.alias("opened_at"), F.timestamp_add("MILLISECOND", F.lit(bar_ms), opened).alias("closed_at"), *prices, V.finite_number(field(5)).alias("volume"), (F.size("fields") == CANDLE_FIELDS).alias("wide"), F.coalesce(field(8) == "1", F.lit(False)).alias("complete"))


def keep_last(rows: DataFrame, keys: Sequence[str], seen: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the one that was seen last. One aggregation: nothing is sorted."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seen)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def newest(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """The newest rows, oldest first: a top-k of every task and one of those, then a sort of limit rows."""
    return rows.orderBy(F.desc(order)).limit(limit).orderBy(order)


def violations(bars: DataFrame, bar_ms: int = BAR_MS, as_of: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Bars with an array of what is wrong with them; parsed() bars or others.

    as_of is the time, as text, after which no bar may close (by more than two seconds). Nothing asks for the present time.
    """
    present = F.col
    gap = V.epoch_ms("opened_at") - F.lag(V.epoch_ms("opened_at")).over(Window.partitionBy(*by, "__part").orderBy("opened_at"))
    checks = [
        (present("opened_at").isNotNull(), "time_invalid"),
        (F.coalesce(F.col("__gap") == bar_ms, F.lit(True)), "not_contiguous"),
        (F.least(*[F.col(c) for c in ("open", "high", "low", "close")]) > 0, "price_invalid"),
        (present("volume") >= 0, "volume_invalid"),
        ((present("high") >= F.greatest("open", "close", "low")) & (present("low") <= F.least("open", "close", "high")), "range_inconsistent"),
        (F.col("__priced"), "price_missing"),
    ]
    if "wide" in bars.columns:
        checks += [(present("wide"), "width_invalid"), (present("complete"), "not_confirmed")]
    if as_of:
        late = F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'{as_of}', closed_at)")
        checks.append((late <= CLOSE_TOLERANCE_MS, "closes_later_than_now"))
    priced = F.lit(True)
    for c in ("open", "high", "low", "close"):
        priced = priced & F.col(c).isNotNull()
    parts = _overlapping(bars, by)
    found = parts.withColumn("__gap", gap).withColumn("__priced", priced).withColumn("violations", V.reasons(*checks))
    return found.filter("__own").drop("__gap", "__priced", "__part", "__own")


def _overlapping(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    """bars by chunks of time, each with a copy of the last bar before it, so that a look back of one needs no whole series."""
    chunk = F.coalesce(time_chunk("opened_at"), F.lit(-1))
    keyed = bars.withColumn("__part", chunk).withColumn("__own", F.lit(True))
    rest = [c for c in bars.columns if c not in by]
    last = keyed.groupBy(*by, "__part").agg(F.max_by(F.struct(*rest), "opened_at").alias("__row"))
    following = Window.partitionBy(*by).orderBy("__part")
    moved = last.withColumn("__next", F.lead("__part").over(following)).filter("__next IS NOT NULL AND __part >= 0")
    carried = moved.select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest], F.col("__next").alias("__part"), F.lit(False).alias("__own"))
    return keyed.unionByName(carried)


def validated(bars: DataFrame, bar_ms: int = BAR_MS, as_of: str | None = None, by: Sequence[str] = (), least: int = LEAST_BARS) -> DataFrame:
    """bars if nothing is wrong with any of them, else an error that names the counts: data sets pass whole or not at all."""
    found = violations(bars, bar_ms, as_of, by)
    total = bars.count()
    wrong = found.select(F.explode("violations").alias("v")).groupBy("v").count().orderBy("v").collect()
    if total < least:
        raise ValueError(f"{total} bars; at least {least} are needed")
    if wrong:
        raise ValueError("bars are not valid: " + ", ".join(f"{r.v} {r['count']}" for r in wrong))
    return bars
