"""Gates as explainable reason codes: promotion, forward test, challenger against champion, order risk, order proposals.

A gate is one projection: an array of the codes of the checks that do not hold, empty where all do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values as V


@dataclass(frozen=True)
class Promotion:
    """Least (or for drawdown, largest) values that a validation report may have. The defaults."""

    folds: int = 3
    oos_rows: int = 200
    trades: int = 10
    cost_bps: float = 5.0
    accuracy: float = 0.50
    net_return: float = 0.0
    worst_fold: float = -0.05
    drawdown: float = 0.15


#: The stricter gate of unattended runs.
LONG_RUN = Promotion(5, 1_000, 20, 24.0, 0.52, 0.005, -0.03, 0.10)


def promotion_reasons(gate: Promotion = LONG_RUN) -> Column:
    """Over a report: supported, folds, oos_rows, trades, cost_bps, aggregate_accuracy, aggregate_net_return, worst_fold_net_return, max_drawdown."""
    c = F.col
    return V.reasons(
        (c("supported"), "unsupported_evaluation_semantics"),
        (c("folds") >= gate.folds, "insufficient_folds"),
        (c("oos_rows") >= gate.oos_rows, "insufficient_oos_rows"),
        (c("trades") >= gate.trades, "insufficient_trades"),
        (c("cost_bps") >= gate.cost_bps, "cost_assumption_too_low"),
        (c("aggregate_accuracy") >= gate.accuracy, "aggregate_accuracy_below_gate"),
        (c("aggregate_net_return") >= gate.net_return, "aggregate_net_return_below_gate"),
        (c("worst_fold_net_return") >= gate.worst_fold, "worst_fold_below_gate"),
        (c("max_drawdown") <= gate.drawdown, "drawdown_above_gate"),
    )


def shadow_reasons(settled_buys: int = 20, days: float = 7.0, drawdown: float = 0.03) -> Column:
    """Over a forward-test summary: settled_buys, duration_days, net_return (must be above 0), max_drawdown (missing: 1)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return V.reasons(
        (zero("settled_buys") >= settled_buys, "shadow_buys_insufficient"),
        (zero("duration_days") >= days, "shadow_duration_insufficient"),
        (zero("net_return") > 0, "shadow_net_return_not_positive"),
        (F.coalesce("max_drawdown", F.lit(1.0)) <= drawdown, "shadow_drawdown_above_limit"),
    )


def against_champion(models: DataFrame, improvement: float = 0.002, regression: float = 0.01) -> DataFrame:
    """models (scope, model_id, state, net_return, max_drawdown) -> validated ones with their reasons against the scope's champion.

    Missing figures on either side, a missing champion's too, are one reason of their own. An equi-join on scope: a
    champion is one row of it.
    """
    champion = models.filter("state = 'champion'").select("scope", F.col("model_id").alias("champion_id"), F.col("net_return").alias("__net"), F.col("max_drawdown").alias("__drawdown"))
    both = models.filter("state = 'validated'").join(champion, "scope")
    known = F.col("net_return").isNotNull() & F.col("max_drawdown").isNotNull() & F.col("__net").isNotNull() & F.col("__drawdown").isNotNull()
    compared = V.reasons((F.col("net_return") >= F.col("__net") + improvement, "challenger_oos_improvement_insufficient"), (F.col("max_drawdown") <= F.col("__drawdown") + regression, "challenger_drawdown_regression"))
    return both.withColumn("reasons", F.when(known, compared).otherwise(F.array(F.lit("champion_comparison_missing")))).drop("__net", "__drawdown")


@dataclass(frozen=True)
class Risk:
    """Limits of one order."""

    market_age_s: float = 8.0
    deviation: str = "0.015"
    notional: str = "25"
    equity_fraction: str = "0.001"
    open_orders: int = 3


def risk_checks(limits: Risk = Risk()) -> Column:
    """Array of {key, passed} over an order beside its market, instrument and account.

    Columns: side, price, size, last, market_age_s, inst_type, inst_state, tick, lot, least_size, equity, quote_balance,
    base_balance, configured, mode, open_orders. An age below 0 counts as 0.
    """
    c = F.col
    notional = c("price") * c("size")
    own_limit = c("equity") * V.literal_price(limits.equity_fraction)
    limit = F.when(own_limit > 0, F.least(V.literal_price(limits.notional).cast("decimal(38,16)"), own_limit.cast("decimal(38,16)"))).otherwise(F.lit(0).cast("decimal(38,16)"))
    deviation = F.when(c("last") > 0, F.abs(c("price") - c("last")) / c("last"))
    balance = F.when(c("side") == "buy", c("quote_balance") >= notional).otherwise(c("base_balance") >= c("size"))
    checks = [
        ("spot_only", (c("inst_type") == "SPOT") & (c("inst_state") == "live")),
        ("market_fresh", F.greatest(F.lit(0.0), c("market_age_s")) <= limits.market_age_s),
        ("price_deviation", deviation <= V.literal_price(limits.deviation)),
        ("instrument_precision", V.is_aligned(c("price"), c("tick")) & V.is_aligned(c("size"), c("lot")) & (c("size") >= c("least_size"))),
        ("single_order", c("configured") & (limit > 0) & (notional <= limit)),
        ("balance", c("configured") & balance),
        ("open_orders", c("open_orders") < limits.open_orders),
        ("armed", c("mode") == "armed"),
        ("credentials", c("configured")),
    ]
    return F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(ok, F.lit(False)).alias("passed")) for k, ok in checks])


def failed_keys(checks: Column) -> Column:
    return F.transform(F.filter(checks, lambda c: ~c["passed"]), lambda c: c["key"])


def proposals(signals: DataFrame, notional: str = "10", market_age_s: float = 8.0, signal_age_s: float = 330.0) -> DataFrame:
    """signals (action, market_age_s, signal_age_s, confirmed, bid, tick, lot, least_size) with price, size and outcome.

    outcome is 'proposed', 'hold', or why the signal is rejected; price is the bid in whole ticks, size what the
    notional buys in whole lots.
    """
    amount = V.literal_price(notional)
    priced = signals.withColumn("price", V.aligned_down(F.col("bid"), F.col("tick")))
    sized = priced.withColumn("size", F.when(F.col("price") > 0, V.order_size(amount, F.col("price"), F.col("lot"))))
    spent = F.col("price") * F.col("size")
    outcome = (
        F.when(~F.col("market_age_s").between(0, market_age_s), "market_stale")
        .when(~F.col("signal_age_s").between(0, signal_age_s), "signal_stale")
        .when(~F.col("confirmed"), "not_confirmed")
        .when(F.col("action") == "hold", "hold")
        .when(F.col("action") == "sell", "sell_not_supported")
        .when((F.coalesce("size", F.lit(0)) <= 0) | (F.col("size") < F.col("least_size")), "below_least_size")
        .when((spent <= 0) | (spent > amount) | (spent > V.literal_price("25")), "above_notional")
        .otherwise("proposed")
    )
    return sized.withColumn("outcome", outcome)
