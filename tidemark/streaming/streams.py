"""Structured Streaming forms: bars from ticks, one row a bar, and signals settled by state.

Every function takes a streaming DataFrame and returns one; `collected` runs one to the end of what is there now and
returns what it gave, for replays and tests. Watermarks bound the state: rows behind them are late and dropped, so a
backfill goes through the batch forms instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import values as V
from tidemark.operators.features import STOP, TAKE
from tidemark.sources.tables import shared_path

WATERMARK = "1 day"


#: State store with column families and timers.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream: a file, or a folder to which files are added. The schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    return reader.parquet(f"{folder}/{{{name}}}")  # as a pattern, a single file may be named too


def feed(rows: DataFrame, arrival: str, parts: int, name: str) -> str:
    """A folder to which rows came in parts, the number of each in the column arrival (left out): what a stream replays in that order."""
    folder = shared_path(rows.sparkSession, name)
    for number in range(parts):
        rows.filter(F.col(arrival) == number).drop(arrival).write.mode("append").parquet(folder)
    return folder


def with_paths(wanted: DataFrame, bars: DataFrame, watermark: str) -> DataFrame:
    """Streams joined on closed_at: every wanted row (signal and step of its holding period) with high, low and close of its bar.

    A step whose bar does not come before the watermark has passed it comes out with nulls, once. State holds the rows of
    the watermark's delay on either side. A join on the closing time spreads one long series over all tasks, as a time
    interval beside an equal series would not.
    """
    clocked = lambda df, name: df.withColumn(name, F.col("closed_at").cast("timestamp")).drop("closed_at").withWatermark(name, watermark)
    left, right = clocked(wanted, "closed"), clocked(bars.select("closed_at", "high", "low", "close"), "bar_closed")
    return left.join(right, F.col("closed") == F.col("bar_closed"), "left_outer").select(*[c for c in wanted.columns if c != "closed_at"], F.col("closed").cast("timestamp_ntz").alias("closed_at"), "high", "low", "close", F.col("bar_closed").isNotNull().alias("there"))


def bars(ticks: DataFrame, seconds: int, watermark: str = WATERMARK) -> DataFrame:
    """Ticks (at, tick_id, step) to the sum, count and extremes of each bar's steps.

    A stream knows the steps of its bars, not the price level before them: that is a sum over all bars before.
    """
    marked = ticks.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", watermark)
    summed = marked.groupBy(F.window("at", f"{seconds} seconds").alias("w")).agg(F.sum("step").alias("total"), F.count("*").alias("volume"), F.max("step").alias("largest_step"), F.min("step").alias("least_step"))
    return summed.select(F.col("w.start").cast("timestamp_ntz").alias("opened_at"), "total", "volume", "largest_step", "least_step")


def once_per_bar(rows: DataFrame, key: str, at: str, watermark: str = WATERMARK) -> DataFrame:
    """The first row of each key; keys are remembered until the watermark passes them."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def settled(feed: DataFrame, hold: int = 12, stop: float = STOP, take: float = TAKE, cost_bps: float = 24.0) -> DataFrame:
    """Bars of each series with buy flags (series, idx, high, low, close, buy) -> settled buys, as state carries them.

    State is the one open position of a series: where it began, its price, and whether a barrier was touched. A buy
    while one is open is passed over, also where a barrier was touched before its time is up. Bars of a series must
    come in the order of idx from batch to batch; within a batch they are put in order.
    """
    schema = "series string, entry_idx long, exit_idx long, exit_close double, net_return double"
    state = "entry long, price double, exit_idx long, exit_close double"

    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = group.getOption
        rows = pd.concat(list(parts)).sort_values("idx", kind="stable")
        out = []
        for r in rows.itertuples():
            if held is not None and r.idx > held[0]:
                entry, price, at, close = held
                if at < 0:
                    if r.low <= price * (1 - stop):
                        at, close = r.idx, price * (1 - stop)
                    elif r.high >= price * (1 + take):
                        at, close = r.idx, price * (1 + take)
                if r.idx - entry >= hold:
                    close = r.close if at < 0 else close
                    out.append((key[0], entry, at if at >= 0 else r.idx, close, close / price - 1 - cost_bps / V.BPS))
                    held = None
                else:
                    held = (entry, price, at, close)
            if held is None and r.buy:
                held = (int(r.idx), float(r.close), -1, 0.0)
        if held is None:
            if group.exists:
                group.remove()
        else:
            group.update(held)
        yield pd.DataFrame(out, columns=["series", "entry_idx", "exit_idx", "exit_close", "net_return"])

    return feed.groupBy("series").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, name: str, mode: str = "append", store: str | None = None) -> DataFrame:
    """Run the stream over what is there now and return its rows as written; in update mode, every version of a row.

    Batches go to a folder of their own, which a repeated batch writes again: column __batch tells them apart. store is
    the state store's class for this stream alone.
    """
    spark = stream.sparkSession
    out = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/__batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(write)
    usual = spark.conf.get(STORE, None)
    if store:
        spark.conf.set(STORE, store)
    try:
        query = writer.start()  # a stream keeps the settings of its start
    finally:
        if store:
            spark.conf.set(STORE, usual) if usual else spark.conf.unset(STORE)
    query.awaitTermination()
    return spark.read.parquet(out)


def newest_versions(rows: DataFrame, key: str) -> DataFrame:
    """Of the versions that update mode gave, the last of each key."""
    rest = [c for c in rows.columns if c not in (key, "__batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "__batch").alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])
