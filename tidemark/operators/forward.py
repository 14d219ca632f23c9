"""Forward tests: signals of frozen models on new bars, settled over the bars that follow, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators.features import FEATURES, STOP, TAKE
from tidemark.operators.research import linear_score, performance, visited

HOLD = 12


def with_models(rows: DataFrame, models: Sequence[dict], columns: Sequence[str] = FEATURES) -> DataFrame:
    """rows once for each model, with score and action. Models are plain data: a few literals in the projection.

    A model: model_id, means, scales, weights, intercept, buy_from, sell_to.
    """
    doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    packed = F.array(*[
        F.struct(F.lit(m["model_id"]).alias("model_id"), doubles(m["means"]).alias("means"), doubles(m["scales"]).alias("scales"), doubles(m["weights"]).alias("weights"), F.lit(float(m["intercept"])).alias("intercept"), F.lit(float(m["buy_from"])).alias("buy_from"), F.lit(float(m["sell_to"])).alias("sell_to"))
        for m in models
    ])
    each = rows.withColumn("__m", F.explode(packed))
    scored = each.withColumn("model_id", F.col("__m.model_id")).withColumn("score", linear_score(columns, F.col("__m.means"), F.col("__m.scales"), F.col("__m.weights"), F.col("__m.intercept")))
    return scored.withColumn("action", V.action(F.col("score"), F.col("__m.buy_from"), F.col("__m.sell_to"))).drop("__m")


def signal_id(*columns: str) -> Column:
    return V.content_id("shadow_", F.concat_ws("|", *columns), 24)


def emitted(scored: DataFrame, bar_seconds: int, hold: int = HOLD) -> DataFrame:
    """Buy signals of each model; a model has no new one until `hold` bars after its last, when that one is due."""
    entered = visited(scored, ["model_id"], hold, "idx", tail=0).filter("entered").drop("entered")
    signals = scored.join(entered, ["model_id", "idx"])
    return signals.select("model_id", "idx", F.col("closed_at").alias("entry_at"), F.timestamp_add("SECOND", F.lit(bar_seconds * hold), "closed_at").alias("due_at"), "action", "score", V.price("close").alias("entry_close"), signal_id("model_id", V.iso_ms("closed_at")).alias("signal_id"))


def steps(signals: DataFrame, bar_seconds: int, hold: int = HOLD) -> DataFrame:
    """Each signal once for each bar of its holding period, with that bar's step and closing time."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(hold))).alias("step")
    return signals.select("*", ahead).withColumn("closed_at", F.timestamp_add("SECOND", F.col("step") * bar_seconds, F.col("entry_at")))


def paths(signals: DataFrame, bars: DataFrame, bar_seconds: int, hold: int = HOLD) -> DataFrame:
    """Each signal beside the bars of its holding period: an equi-join on closing times, no range join."""
    return steps(signals, bar_seconds, hold).join(bars.select("closed_at", "high", "low", "close"), "closed_at")


def settled(signals: DataFrame, bars: DataFrame, bar_seconds: int, cost_bps: float = 24.0, hold: int = HOLD, stop: float = STOP, take: float = TAKE) -> DataFrame:
    """Signals whose path is whole, with exit_close and net_return: stop first within a bar, then target, else the last close.

    Prices are exact, unlike those of research labels. Signals that buy nothing earn nothing. A signal whose path has a
    gap is left for backfilled bars: see incomplete().
    """
    return closed(paths(signals, bars, bar_seconds, hold), cost_bps, hold, stop, take)


def closed(found: DataFrame, cost_bps: float = 24.0, hold: int = HOLD, stop: float = STOP, take: float = TAKE) -> DataFrame:
    """settled() of rows that paths() gave, or a stream of them."""
    one = V.literal_price("1")
    low, high = (F.col("entry_close") * (one - V.literal_price(str(stop)))), (F.col("entry_close") * (one + V.literal_price(str(take))))
    touched = F.when(V.price("low") <= low, low.cast("decimal(38,16)")).when(V.price("high") >= high, high.cast("decimal(38,16)"))
    keys = ["signal_id", "model_id", "entry_at", "due_at", "action", "entry_close"]
    ended = found.withColumn("touch", touched).groupBy(*keys).agg(
        F.count("*").alias("bars"),
        F.min_by(F.when(F.col("touch").isNotNull(), F.struct("touch", "step")), F.when(F.col("touch").isNotNull(), F.col("step"))).alias("hit"),
        F.max_by("close", "step").alias("last_close"),
    )
    out = ended.filter(F.col("bars") == hold).withColumn("exit_close", F.coalesce(F.col("hit.touch"), V.price("last_close").cast("decimal(38,16)")))
    net = F.when(F.col("action") == "buy", F.col("exit_close").cast("double") / F.col("entry_close").cast("double") - 1 - cost_bps / V.BPS).otherwise(0.0)
    return out.select(*keys, F.col("hit.step").alias("exit_step"), "exit_close", net.alias("net_return"), F.col("due_at").alias("settled_at"))


def incomplete(signals: DataFrame, bars: DataFrame, bar_seconds: int, as_of: str, hold: int = HOLD) -> DataFrame:
    """Due signals whose path lacks bars, with how many: what a backfill has to bring before they can be settled."""
    due = signals.filter(F.col("due_at") <= F.lit(as_of).cast("timestamp_ntz"))
    there = paths(due, bars, bar_seconds, hold).groupBy("signal_id").agg(F.count("*").alias("bars"))
    return due.join(there, "signal_id", "left").select("signal_id", "entry_at", "due_at", (F.lit(hold) - F.coalesce("bars", F.lit(0))).alias("missing")).filter("missing > 0")


def pending(signals: DataFrame, as_of: str) -> DataFrame:
    """Unsettled signals that are due, in order."""
    return signals.filter(F.col("settled_at").isNull() & (F.col("due_at") <= F.lit(as_of).cast("timestamp_ntz"))).orderBy("due_at", "signal_id")


def summary(done: DataFrame) -> DataFrame:
    """One row a model: settled signals and buys, net return, drawdown, first signal, last settlement, days between.

    The last settlement is that of the last signal by entry, not the latest time.
    """
    base = done.groupBy("model_id").agg(F.count("*").alias("settled_signals"), F.count_if(F.col("action") == "buy").alias("settled_buys"), F.min("entry_at").alias("first_signal_at"), F.max_by("settled_at", F.struct("entry_at", "signal_id")).alias("last_settled_at"))
    buys = performance(done.filter("action = 'buy'"), ["model_id"], ["entry_at", "signal_id"], "net_return").drop("trades")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    joined = base.join(buys, "model_id", "left")
    return joined.select("model_id", "settled_signals", "settled_buys", zero("net_return"), zero("max_drawdown"), "first_signal_at", "last_settled_at", V.days_between("first_signal_at", "last_settled_at").alias("duration_days"))


def without_open_buy(models: DataFrame, signals: DataFrame) -> DataFrame:
    """Models that have no unsettled buy."""
    return models.join(signals.filter("settled_at IS NULL AND action = 'buy'").select("model_id"), "model_id", "left_anti")
