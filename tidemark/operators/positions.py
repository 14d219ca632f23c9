"""Positions from fills: exact inventory, fees, proceeds and realised returns, folded in order for each position.

Sizes are DECIMAL(18,8), quote values DECIMAL(38,16): their product is exact. Fees are signed, a negative one is a cost.
A base-currency fee changes the size that is owned or delivered, a quote-currency fee the proceeds or cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators.machines import ACTIVE_POSITION

QUOTE = "decimal(38,16)"
STOP, TAKE, ATTEMPTS = "0.015", "0.025", 5
BASE_UNIT, QUOTE_UNIT = "BTC", "USDT"


def _unit(column: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(column), F.lit(""))))


def entries(fills: DataFrame, stop: str = STOP, take: str = TAKE) -> DataFrame:
    """fills (position_id, requested, filled, average, fee, fee_unit) -> the position that each entry leaves behind.

    Adds status ('long', 'entry_unfilled' or 'invalid'), reason, owned, cost, stop_price and take_price.
    """
    fee, unit = F.coalesce(V.price("fee"), V.literal_price("0")), _unit("fee_unit")
    filled, average = V.price("filled"), V.price("average")
    owned = V.price(filled + F.when(unit == BASE_UNIT, fee).otherwise(F.lit(0).cast(V.PRICE)))
    cost = (filled * average - F.when(unit == QUOTE_UNIT, fee).otherwise(F.lit(0).cast(V.PRICE))).cast(QUOTE)
    reason = (
        F.when(~unit.isin("", BASE_UNIT, QUOTE_UNIT), "fee_unit_unknown")
        .when((filled > 0) & average.isNull(), "average_missing")
        .when(filled > V.price("requested"), "filled_above_requested")
        .when((owned < 0) | (owned > filled), "fee_invalid")
    )
    status = F.when(reason.isNotNull(), "invalid").when(owned == 0, "entry_unfilled").otherwise("long")
    level = lambda f: V.price(average * f)
    held = F.col("status") == "long"
    out = fills.withColumn("reason", reason).withColumn("status", status).withColumn("owned", owned).withColumn("cost", cost)
    one = V.literal_price("1")
    return out.withColumn("stop_price", F.when(held, level(one - V.literal_price(stop)))).withColumn("take_price", F.when(held, level(one + V.literal_price(take))))


def exits(opened: DataFrame, fills: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Long positions of entries() after their exit fills (position_id, number, filled, average, fee, fee_unit) in order.

    Returns position_id, status ('closed', 'long', 'manual_review' or 'invalid'), reason, remaining, exited, proceeds,
    exit_average, tries and realised_return. A position without exit fills stays long. Fills after the end change
    nothing. A position ends with its attempt number `attempts` at the latest, so that many steps of plain columns are the whole fold; a
    fold by a lambda would be interpreted value by value.
    """
    unit = _unit("fee_unit")
    each = fills.select("position_id", F.struct("number", V.price("filled").alias("filled"), F.coalesce(V.price("average"), V.literal_price("0")).alias("average"), F.col("average").isNull().alias("unpriced"), F.coalesce(V.price("fee"), V.literal_price("0")).alias("fee"), unit.alias("unit")).alias("x"))
    gathered = each.groupBy("position_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    joined = opened.filter("status = 'long'").select("position_id", "owned", "cost").join(gathered, "position_id", "left")
    zero = V.literal_price("0")
    held = {"status": F.lit("long"), "reason": F.lit(None).cast("string"), "unit": F.lit(""), "fees": zero, "remaining": V.price("owned"), "exited": zero, "proceeds": F.lit(0).cast(QUOTE), "tries": F.lit(0)}
    done = joined.select("position_id", "cost", "xs", *[c.alias(n) for n, c in held.items()])
    for number in range(attempts):
        done = _attempted(done, F.get("xs", F.lit(number)), number + 1 >= attempts).select("position_id", "cost", "xs", *held)
    done = done.drop("xs", "unit", "fees")
    average = F.when(F.col("exited") > 0, F.col("proceeds").cast("double") / F.col("exited").cast("double"))
    gain = F.when(F.col("status") == "closed", F.col("proceeds").cast("double") / F.col("cost").cast("double") - 1)
    return done.withColumn("exit_average", average).withColumn("realised_return", gain)


def _attempted(rows: DataFrame, x: Column, final: bool) -> DataFrame:
    """rows after their exit fill x, null if there is none; with final, what is still long goes to a person.

    Every value is a column of its own, so that it is computed once, and only where the position is long.
    """
    live = rows.withColumn("__x", x).withColumn("__live", (F.col("status") == "long") & F.col("__x").isNotNull())
    base, quoted = F.when(F.col("__x.unit") == BASE_UNIT, F.col("__x.fee")), F.when(F.col("__x.unit") == QUOTE_UNIT, F.col("__x.fee"))
    debit = F.col("__x.filled") - F.coalesce(base, V.literal_price("0"))
    quote = (F.col("__x.filled") * F.col("__x.average") + F.coalesce(quoted, V.literal_price("0"))).cast(QUOTE)
    sized = live.withColumns({"__debit": F.when(F.col("__live"), debit), "__quote": F.when(F.col("__live"), quote)})
    unit, named = F.col("__x.unit"), F.col("__x.unit") != ""
    wrong = (
        F.when(~unit.isin("", BASE_UNIT, QUOTE_UNIT), "fee_unit_unknown")
        .when((F.col("__x.filled") > 0) & (F.col("__x.unpriced") | (F.col("__x.average") <= 0)), "average_missing")
        .when((F.col("__debit") < 0) | (F.col("__debit") > F.col("remaining")), "exit_above_remaining")
        .when((F.col("__x.fee") != 0) & (F.col("fees") != 0) & named & (F.col("unit") != "") & (unit != F.col("unit")), "fee_unit_changed")
        .when(F.col("__quote") < 0, "fee_invalid")
        .when((F.col("__debit") == F.col("remaining")) & ~(F.col("cost") > 0), "entry_cost_invalid")
    )
    judged = sized.withColumn("__wrong", F.when(F.col("__live"), wrong)).withColumn("__good", F.col("__live") & F.col("__wrong").isNull())
    good, left = F.col("__good"), F.col("remaining") - F.col("__debit")
    ends = F.when(F.col("__wrong").isNotNull(), "invalid").when(F.col("__debit") == F.col("remaining"), "closed").otherwise("manual_review" if final else "long")
    spent = F.when(good & (F.col("__debit") != F.col("remaining")), "exit_attempts_exhausted") if final else F.lit(None).cast("string")
    return judged.withColumns({
        "status": F.when(F.col("__live"), ends).otherwise(F.col("status")),
        "reason": F.when(F.col("__live"), F.coalesce("__wrong", spent)).otherwise(F.col("reason")),
        # the last unit that a fill names, whatever its fee; units are held against each other while the fees so far are not 0
        "unit": F.when(good & named, unit).otherwise(F.col("unit")),
        "fees": F.when(good, V.price(F.col("fees") + F.col("__x.fee"))).otherwise(F.col("fees")),
        "remaining": F.when(good, V.price(left)).otherwise(F.col("remaining")),
        "exited": F.when(good, V.price(F.col("exited") + F.col("__x.filled"))).otherwise(F.col("exited")),
        "proceeds": F.when(good, (F.col("proceeds") + F.col("__quote")).cast(QUOTE)).otherwise(F.col("proceeds")),
        "tries": F.col("tries") + F.col("__live").cast("int"),
    })


def fill_accounting(fills: DataFrame, by: str) -> DataFrame:
    """Totals of fills (filled, average, fee in quote units) for each key: size, proceeds and their weighted price."""
    quote = (V.price("filled") * V.price("average")).cast(QUOTE) + V.price("fee").cast(QUOTE)
    summed = fills.groupBy(by).agg(F.count("*").alias("fills"), F.sum(V.price("filled")).alias("size"), F.sum(quote.cast(QUOTE)).alias("proceeds"))
    return summed.withColumn("average", F.when(F.col("size") > 0, F.col("proceeds").cast("double") / F.col("size").cast("double")))


def exit_reason(last: Column, now: str) -> Column:
    """Why a held position must end at this price and time, if it must: columns stop_price, take_price, due_at, hard_due_at."""
    at = F.lit(now).cast("timestamp_ntz")
    return F.when(last <= F.col("stop_price"), "stop").when(last >= F.col("take_price"), "take").when(at >= F.col("hard_due_at"), "hard_due").when(at >= F.col("due_at"), "due")


def several_active(positions: DataFrame, by: str) -> DataFrame:
    """Keys with more than one position that is not at its end; there must be none."""
    return positions.filter(F.col("status").isin(*ACTIVE_POSITION)).groupBy(by).count().filter("count > 1")
