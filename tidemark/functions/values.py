"""Scalar building blocks as column expressions: exact prices, times, scores, strict parsing.

Everything here stays in the JVM. Prices and sizes are DECIMAL(18,8): a quotient of two of them keeps 20 digits behind
the point, where wider operands would lose theirs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(18,8)"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
BPS = 10_000.0


def price(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast(PRICE)


def literal_price(value: str) -> Column:
    """An exact literal; value is text so that no binary float comes between."""
    return F.lit(value).cast(PRICE)


def decimal_or_zero(text: Column) -> Column:
    """Text as an exact number; what is not a number counts as 0."""
    return F.coalesce(text.try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))


def finite_number(text: Column, above: float | None = None) -> Column:
    """Text as a double if it is a plain finite number (larger than above, if given), else null."""
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    low = float("-inf") if above is None else above
    return F.when((number > low) & (number < float("inf")), number)


def aligned_down(value: Column, step: Column) -> Column:
    """Largest multiple of step up to value; null where step is not positive."""
    return F.when(step > 0, (F.floor(value / step) * step).cast(PRICE))


def aligned_up(value: Column, step: Column) -> Column:
    return F.when(step > 0, (F.ceil(value / step) * step).cast(PRICE))


def is_aligned(value: Column, step: Column) -> Column:
    return F.coalesce((step > 0) & (value % step == 0), F.lit(False))


def order_size(notional: Column, at: Column, lot: Column) -> Column:
    """Size that a notional buys, in whole lots; one division, so that no digit is lost before rounding down."""
    return (F.floor(notional / (at * lot)) * lot).cast(PRICE)


def epoch_ms(column: str) -> Column:
    """Milliseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, CAST({column} AS TIMESTAMP_NTZ))")


def from_ms(ms: Column) -> Column:
    """Time without zone from milliseconds since 1970."""
    return F.timestamp_add("MILLISECOND", ms, F.expr(EPOCH))


def seconds_or_millis(value: Column) -> Column:
    """Milliseconds from a number of seconds or milliseconds, told apart by its size."""
    return F.when(value >= 1_000_000_000_000, value).otherwise(value * 1000)


def iso_ms(column: Column | str) -> Column:
    """ISO-8601 text in milliseconds with Z; its text order is its time order."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def days_between(first: str, last: str) -> Column:
    """Days as a double, never negative."""
    return F.greatest(F.lit(0.0), (epoch_ms(last) - epoch_ms(first)) / F.lit(86_400_000.0))


def sigmoid(z: Column) -> Column:
    """Logistic function that does not overflow on either side."""
    small = F.exp(F.greatest(z, F.lit(-700.0)))
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-F.least(z, F.lit(700.0))))).otherwise(small / (1.0 + small))


def action(score: Column, buy_from: Column | float, sell_to: Column | float) -> Column:
    """buy at or above the one threshold, sell at or below the other, else hold."""
    return F.when(score >= buy_from, "buy").when(score <= sell_to, "sell").otherwise("hold")


def growth(change: Column) -> Column:
    """Factor that a return multiplies equity by; a loss beyond everything leaves 0."""
    return F.greatest(F.lit(0.0), 1.0 + change)


def hour_angle(column: str) -> Column:
    return (F.hour(column) + F.minute(column) / 60.0) * (2 * F.pi() / 24)


def weekday_angle(column: str) -> Column:
    return F.weekday(column) * (2 * F.pi() / 7)


def is_sha256(column: str) -> Column:
    return F.coalesce(F.col(column).rlike("^[0-9a-f]{64}$"), F.lit(False))


def content_id(prefix: str, text: Column, length: int) -> Column:
    """A prefix and the first hex digits of the SHA-256 of text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def strict_flag(text: Column) -> Column:
    """'true' or 'false' as a boolean; anything else stops the query, null stays null."""
    wrong = F.raise_error(F.concat(F.lit("not a flag: "), text)).cast("boolean")
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(text == "true", True).when(text == "false", False).otherwise(wrong)


def percent_change(last: Column, first: Column) -> Column:
    return F.when(first != 0, (last - first) / first * 100.0)


def clipped(text: Column, length: int = 512) -> Column:
    """Trimmed text of at most so many characters."""
    return F.substring(F.trim(text), 1, length)


def reasons(*checks: tuple[Column, str]) -> Column:
    """Codes of the checks that do not hold, in order; a check that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in checks]))


def same_keys(left: Column, right: Column) -> Column:
    """Whether two arrays hold the same set."""
    return (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0)
