"""Sixteen look-back features and the bracket label of regular bars.

All of them look at most BACK bars back and `horizon` bars ahead. So a series is cut into chunks of `chunk` bars, each
with copies of its neighbours' bars that its own need, and every chunk is a window partition: a single long series
spreads over as many tasks as it has chunks, with one shuffle for everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.sources.bars import indexed

BACK = 48
CHUNK = 4096
#: The order in which models read the features.
FEATURES = (
    "return_1", "return_3", "return_12", "return_24", "return_48",
    "volatility_12", "volatility_48", "range_1", "relative_volume_24",
    "ema_distance_12", "ema_distance_48", "rsi_14",
    "hour_sin", "hour_cos", "weekday_sin", "weekday_cos",
)
HORIZON, COST_BPS, STOP, TAKE = 12, 24.0, 0.015, 0.025


def chunked(bars: DataFrame, back: int, ahead: int, chunk: int = CHUNK, by: Sequence[str] = ()) -> DataFrame:
    """Indexed bars with __chunk and __own: every bar in its chunk, and copies of it in the chunks whose bars look at it."""
    if chunk < max(back, ahead):
        raise ValueError("a chunk must be as long as the farthest look")
    part, place = F.floor(F.col("idx") / chunk), F.col("idx") % chunk
    copies = F.array_compact(F.array(F.struct(part.alias("part"), F.lit(True).alias("own")), F.when(place >= chunk - back, F.struct((part + 1).alias("part"), F.lit(False).alias("own"))), F.when((place < ahead) & (part > 0), F.struct((part - 1).alias("part"), F.lit(False).alias("own")))))
    return bars.withColumn("__copy", F.explode(copies)).withColumn("__chunk", F.col("__copy.part")).withColumn("__own", F.col("__copy.own")).drop("__copy")


def _ema(closes: Column, n: int) -> Column:
    """Average of the last n closes: the first one as it is, every later one with weight 2 / (n + 1)."""
    alpha = 2.0 / (n + 1)
    last = F.slice(closes, -n, n)
    return F.aggregate(F.slice(last, 2, n - 1), F.get(last, F.lit(0)), lambda mean, close: alpha * close + (1 - alpha) * mean)


def _look_back(w: Window) -> dict[str, Column]:
    close, volume = F.col("close"), F.col("volume")
    last = lambda n: w.rowsBetween(1 - n, 0)
    mean_volume = F.avg(volume).over(last(24))
    up, down = (F.sum(F.greatest(x, F.lit(0.0))).over(last(14)) for x in (F.col("__delta"), -F.col("__delta")))
    hour, weekday = V.hour_angle("closed_at"), V.weekday_angle("closed_at")
    out = {f"return_{k}": close / F.lag(close, k).over(w) - 1 for k in (1, 3, 12, 24, 48)}
    out |= {f"volatility_{n}": F.stddev_pop("__change").over(last(n)) for n in (12, 48)}
    out |= {"range_1": (F.col("high") - F.col("low")) / close, "relative_volume_24": F.when(mean_volume > 0, volume / mean_volume).otherwise(1.0)}
    out |= {f"ema_distance_{n}": close / _ema(F.col("__closes"), n) - 1 for n in (12, 48)}
    out |= {"rsi_14": F.when(up + down > 0, up / (up + down)).otherwise(0.5)}
    return out | {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "weekday_sin": F.sin(weekday), "weekday_cos": F.cos(weekday)}


def _bracket(path: Column, entry: Column, stop: float, take: float) -> Column:
    """Return of a long position over the bars of path: the stop is tested first in every bar, then the target, else the last close."""
    low, high = entry * (1 - stop), entry * (1 + take)
    touch = F.aggregate(path, F.lit(None).cast("double"), lambda seen, bar: F.coalesce(seen, F.when(bar["low"] <= low, F.lit(-stop)).when(bar["high"] >= high, F.lit(take))))
    return F.coalesce(touch, F.element_at(path, -1)["close"] / entry - 1)


def _windowed(bars: DataFrame, back: int, ahead: int, chunk: int, by: Sequence[str]) -> tuple[DataFrame, Window]:
    rows = bars if "idx" in bars.columns else indexed(bars, by)
    return chunked(rows, back, ahead, chunk, by), Window.partitionBy(*by, "__chunk").orderBy("idx")


def features(bars: DataFrame, by: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """One row a bar that has BACK bars before it: by, idx, opened_at, closed_at, close and the features."""
    return _assembled(bars, None, by, chunk)


def observations(bars: DataFrame, horizon: int = HORIZON, cost_bps: float = COST_BPS, stop: float = STOP, take: float = TAKE, by: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """features() of bars with `horizon` bars ahead, with forward_return and label (1 if it is above the cost)."""
    if not (1 <= horizon <= 96 and 0 < stop <= 0.05 and 0 < take <= 0.10):
        raise ValueError("horizon, stop or take is out of bounds")
    return _assembled(bars, (horizon, cost_bps, stop, take), by, chunk)


def _assembled(bars: DataFrame, bracket: tuple[int, float, float, float] | None, by: Sequence[str], chunk: int) -> DataFrame:
    ahead = bracket[0] if bracket else 0
    rows, w = _windowed(bars, BACK, ahead, chunk, by)
    delta = F.col("close") - F.lag("close").over(w)
    first = rows.withColumn("__delta", delta).withColumn("__change", F.col("close") / F.lag("close").over(w) - 1).withColumn("__closes", F.collect_list("close").over(w.rowsBetween(1 - BACK, 0)))
    kept = [*by, "idx", "opened_at", "closed_at", "close"]
    if bracket:
        _, cost_bps, stop, take = bracket
        first = first.withColumn("__path", F.collect_list(F.struct("high", "low", "close")).over(w.rowsBetween(1, ahead)))
    looked = first.select(*kept, "__own", *(["__path"] if bracket else []), *[c.alias(n) for n, c in _look_back(w).items()])
    own = looked.filter(F.col("__own") & (F.col("idx") >= BACK))
    if not bracket:
        return own.select(*kept, *FEATURES)
    labelled = own.filter(F.size("__path") == ahead).withColumn("forward_return", _bracket(F.col("__path"), F.col("close"), stop, take))
    return labelled.select(*kept, *FEATURES, "forward_return", (F.col("forward_return") > cost_bps / V.BPS).cast("int").alias("label"))


def bracket_labels(bars: DataFrame, horizon: int = HORIZON, cost_bps: float = COST_BPS, stop: float = STOP, take: float = TAKE, by: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """forward_return and label alone, for bars with `horizon` bars ahead and BACK before."""
    rows, w = _windowed(bars, BACK, horizon, chunk, by)
    path = rows.withColumn("__path", F.collect_list(F.struct("high", "low", "close")).over(w.rowsBetween(1, horizon)))
    own = path.filter(F.col("__own") & (F.col("idx") >= BACK) & (F.size("__path") == horizon))
    labelled = own.withColumn("forward_return", _bracket(F.col("__path"), F.col("close"), stop, take))
    return labelled.select(*by, "idx", "opened_at", "closed_at", "close", "forward_return", (F.col("forward_return") > cost_bps / V.BPS).cast("int").alias("label"))


def latest(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Features of the newest bar: only the bars that it looks at are read into the windows."""
    tail = bars.orderBy(F.desc("opened_at")).limit(BACK + 1)
    return features(tail, chunk=chunk).orderBy(F.desc("opened_at")).limit(1)


def not_finite(rows: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Rows with a feature that is missing or not finite; a valid set has none."""
    bad = F.lit(False)
    for c in columns:
        x = F.col(c)
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(bad)


def observation_faults(rows: DataFrame) -> DataFrame:
    """Observations outside their domain: label 0 or 1, return above -1 and up to 1, features finite."""
    wrong = ~F.col("label").isin(0, 1) | ~((F.col("forward_return") > -1) & (F.col("forward_return") <= 1))
    return rows.filter(F.coalesce(wrong, F.lit(True))).unionByName(not_finite(rows)).distinct()
