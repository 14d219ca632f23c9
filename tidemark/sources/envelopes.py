"""Envelopes of market data as text: rows that pass go on, every other one to a quarantine with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import shapes
from tidemark.functions import values as V
from tidemark.sources.bars import CANDLE_FIELDS

_ITEMS = "array<variant>"


def _scalar(part: Column) -> Column:
    return shapes.is_kind(part, "string") | shapes.is_kind(part, "number")


def judged(raw: DataFrame, text: str, candles: bool = True) -> DataFrame:
    """raw with reason (null if the envelope is sound) and items, its data as arrays of text (candles) or JSON texts.

    Reasons: not_json, not_object, code_missing (no text or number), code_refused (not 0), data_invalid (no list; absent counts as
    an empty one), items_invalid (a candle that is no array of 9 texts or numbers, or another item that is no object).
    """
    doc = raw.withColumn("__v", shapes.parsed(F.col(text)))
    code, data = shapes.part_of(F.col("__v"), "code"), shapes.part_of(F.col("__v"), "data")
    items = F.coalesce(F.try_variant_get(data, "$", _ITEMS), F.array().cast(_ITEMS))
    wide = lambda x: F.try_variant_get(x, "$", _ITEMS)
    candle = lambda x: F.coalesce(F.size(wide(x)) == CANDLE_FIELDS, F.lit(False)) & F.coalesce(F.forall(wide(x), _scalar), F.lit(False))
    sound = F.forall(items, candle if candles else (lambda x: shapes.is_kind(x, "object")))
    reason = (
        F.when(F.col("__v").isNull(), "not_json")
        .when(~shapes.is_kind(F.col("__v"), "object"), "not_object")
        .when(~(shapes.is_kind(code, "string") | shapes.is_kind(code, "integer")), "code_missing")
        .when(F.try_variant_get(code, "$", "string") != "0", "code_refused")
        .when(data.isNotNull() & ~shapes.is_kind(data, "list"), "data_invalid")
        .when(~sound, "items_invalid")
    )
    out = doc.withColumn("reason", reason)
    good = F.col("reason").isNull()
    if candles:
        return out.withColumn("items", F.when(good, F.transform(items, lambda x: F.transform(wide(x), lambda y: F.try_variant_get(y, "$", "string"))))).drop("__v")
    return out.withColumn("items", F.when(good, F.transform(items, lambda x: x.cast("string")))).drop("__v")


def split(raw: DataFrame, text: str, candles: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine): accepted has a row for every item (fields or item), quarantine the envelopes that are not sound."""
    found = judged(raw, text, candles)
    accepted = found.filter("reason IS NULL").drop("reason", text).withColumn("fields" if candles else "item", F.explode("items")).drop("items")
    return accepted, found.filter("reason IS NOT NULL").drop("items")


def ticker_faults(instrument: str, as_of: str, ahead_ms: int = 2000) -> Column:
    """Codes of what is wrong with a ticker beside its instrument: columns inst_id, last, ts (texts), meta_inst_id, meta_type."""
    ms = F.when(F.col("ts").rlike(r"^\d+$"), F.col("ts").try_cast("bigint"))
    now = F.expr(f"timestampdiff(MILLISECOND, {V.EPOCH}, TIMESTAMP_NTZ'{as_of}')")
    return V.reasons(
        (F.col("inst_id") == instrument, "instrument_differs"), (V.finite_number(F.trim("last"), 0).isNotNull(), "last_invalid"),
        ((ms > 0) & (ms <= now + ahead_ms), "time_invalid"), ((F.col("meta_type") == "SPOT") & (F.col("meta_inst_id") == instrument), "not_spot"),
    )


def snapshot_faults(instrument: str) -> Column:
    """Codes of what is wrong with a market snapshot: observed_at, closed_at, instrument, bid, ask, tick, lot, least_size (exact numbers)."""
    positive = [(F.col(c) > 0, f"{c}_invalid") for c in ("bid", "ask", "tick", "lot", "least_size")]
    return V.reasons((F.col("closed_at") <= F.col("observed_at"), "close_in_future"), (F.col("instrument") == instrument, "instrument_differs"), *positive, (F.col("bid") <= F.col("ask"), "bid_above_ask"))


def fresh(at: str, now: Column, oldest_s: float, newest_s: float = 0.0) -> Column:
    """Whether a time lies at most oldest_s before now and not further ahead than -newest_s; the last close has 360 and -2, a ticker 8 and 0."""
    age = (F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col(at).cast("timestamp"))) / F.lit(1000.0)
    return F.coalesce((age >= newest_s) & (age <= oldest_s), F.lit(False))
