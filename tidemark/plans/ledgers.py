"""Queries over orders, fills and event logs: gates, registry, budgets, positions, state, integrity.

The tables orders, lineitem, customer and events stand in for models, reports, fills and logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import values as V
from tidemark.operators import gates, integrity, machines, positions, registry, state
from tidemark.plans.series import r, stamped
from tidemark.plans.sql import rounded as _R
from tidemark.plans.sql import stamp as _S
from tidemark.sources.bars import newest, table
from tidemark.sources.tables import stored

ENTRY_MOVES = {("observe", "purchase"): "armed", ("armed", "error"): "killed", ("armed", "view"): "observe", ("killed", "signup"): "observe"}
ALLOWED = [(None, "click"), (None, "view"), ("click", "view"), ("view", "click"), ("view", "purchase"), ("purchase", "view"), ("click", "error")]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _share(status: str) -> Column:
    return F.count_if(F.col("o_orderstatus") == status) / F.count("*")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up validation report for each customer, from counts only."""
    n = F.count("*")
    return _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("model_id")).agg(
        F.count_distinct(F.year("o_orderdate")).alias("folds"), (n * 100).alias("oos_rows"), (n * 2).alias("trades"), r(_share("F")).alias("aggregate_accuracy"),
        r((F.count_if(F.col("o_orderstatus") == "O") - F.count_if(F.col("o_orderstatus") == "P")) / n / 50).alias("aggregate_net_return"),
        r(-_share("P") / 10).alias("worst_fold_net_return"), r(_share("P") / 4).alias("max_drawdown"),
    ).withColumn("cost_bps", 20.0 + F.col("model_id") % 10).withColumn("supported", F.col("model_id") % 20 != 0)


_REPORTS = """reports AS (
  SELECT o_custkey AS model_id, count(DISTINCT year(o_orderdate)) AS folds, count(*) * 100 AS oos_rows, count(*) * 2 AS trades,
    round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS aggregate_accuracy,
    round((count(*) FILTER (o_orderstatus = 'O') - count(*) FILTER (o_orderstatus = 'P')) / count(*) / 50, 6) AS aggregate_net_return,
    round(-(count(*) FILTER (o_orderstatus = 'P') / count(*)) / 10, 6) AS worst_fold_net_return, round(count(*) FILTER (o_orderstatus = 'P') / count(*) / 4, 6) AS max_drawdown,
    20 + o_custkey % 10 AS cost_bps, o_custkey % 20 <> 0 AS supported
  FROM orders GROUP BY o_custkey)"""
_PROMOTION = """concat_ws(',', CASE WHEN NOT supported THEN 'unsupported_evaluation_semantics' END, CASE WHEN folds < 5 THEN 'insufficient_folds' END, CASE WHEN oos_rows < 1000 THEN 'insufficient_oos_rows' END,
  CASE WHEN trades < 20 THEN 'insufficient_trades' END, CASE WHEN cost_bps < 24 THEN 'cost_assumption_too_low' END, CASE WHEN aggregate_accuracy < 0.52 THEN 'aggregate_accuracy_below_gate' END,
  CASE WHEN aggregate_net_return < 0.005 THEN 'aggregate_net_return_below_gate' END, CASE WHEN worst_fold_net_return < -0.03 THEN 'worst_fold_below_gate' END, CASE WHEN max_drawdown > 0.1 THEN 'drawdown_above_gate' END)"""
_SHADOW = """concat_ws(',', CASE WHEN settled_buys < 20 THEN 'shadow_buys_insufficient' END, CASE WHEN duration_days < 7 THEN 'shadow_duration_insufficient' END,
  CASE WHEN net_return <= 0 THEN 'shadow_net_return_not_positive' END, CASE WHEN coalesce(max_drawdown, 1) > 0.03 THEN 'shadow_drawdown_above_limit' END)"""


def promotion_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("model_id", F.array_join(gates.promotion_reasons(), ",").alias("reasons"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _reports(spark, sf_dir)
    return own.select("model_id", F.col("trades").alias("settled_buys"), (F.col("oos_rows") / 200).alias("duration_days"), F.col("aggregate_net_return").alias("net_return"), F.when(F.col("model_id") % 7 != 0, F.col("max_drawdown")).alias("max_drawdown"))


_SUMMARIES = "summaries AS (SELECT model_id, trades AS settled_buys, oos_rows / 200 AS duration_days, aggregate_net_return AS net_return, CASE WHEN model_id % 7 <> 0 THEN max_drawdown END AS max_drawdown FROM reports)"


def shadow_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir).select("model_id", F.array_join(gates.shadow_reasons(), ",").alias("reasons"))


def challenger_vs_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _reports(spark, sf_dir).select((F.col("model_id") % 10).alias("scope"), "model_id", F.when(F.col("model_id") < 30, "champion").otherwise("validated").alias("state"), F.when(F.col("model_id") % 11 != 0, F.col("aggregate_net_return")).alias("net_return"), "max_drawdown")
    single = own.filter(~((F.col("state") == "champion") & (F.col("model_id") >= 10)))
    return gates.against_champion(single).select("scope", "model_id", "champion_id", F.array_join("reasons", ",").alias("reasons"))


def model_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"), F.lit("validated").alias("state"))
    found = registry.reviews(models, _reports(spark, sf_dir).filter("model_id % 4 != 0"), _summaries(spark, sf_dir).filter("model_id % 3 != 0"))
    return found.select("model_id", F.array_join("all_reasons", ",").alias("reasons"))


def risk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    exact = lambda c: V.price(c)
    rows = _orders(spark, sf_dir).select(
        "o_orderkey", F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), (V.literal_price("64000.0") + exact(k % 2000) - V.literal_price("1000") + exact(k % 3) * V.literal_price("0.05")).cast(V.PRICE).alias("price"),
        (exact(k % 50 + 1) * V.literal_price("0.00001") + exact(k % 5) * V.literal_price("0.000001")).cast(V.PRICE).alias("size"), V.literal_price("64000").alias("last"), ((k % 12) * 1.0 - 1).alias("market_age_s"),
        F.when(k % 31 == 0, "SWAP").otherwise("SPOT").alias("inst_type"), F.lit("live").alias("inst_state"), V.literal_price("0.1").alias("tick"), V.literal_price("0.00001").alias("lot"), V.literal_price("0.00001").alias("least_size"),
        exact((k % 40) * 1000).alias("equity"), exact(k % 30).alias("quote_balance"), V.literal_price("0.0002").alias("base_balance"), (k % 41 != 0).alias("configured"), F.when(k % 6 == 0, "observe").otherwise("armed").alias("mode"), (k % 5).alias("open_orders"),
    )
    failed = gates.failed_keys(gates.risk_checks())
    return rows.select("o_orderkey", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("allowed"))


_RISK = """rows AS (SELECT o_orderkey, o_orderkey AS k,
    CAST(63000 + k % 2000 AS DECIMAL(18,8)) + CAST(k % 3 AS DECIMAL(9,0)) * 0.05 AS price, CAST(k % 50 + 1 AS DECIMAL(9,0)) * 0.00001 + CAST(k % 5 AS DECIMAL(9,0)) * 0.000001 AS size FROM orders),
units AS (SELECT *, CAST(round(price * 100) AS BIGINT) AS cents, CAST(round(size * 1000000) AS BIGINT) AS micro FROM rows),
found AS (SELECT o_orderkey, concat_ws(',',
  CASE WHEN k % 31 = 0 THEN 'spot_only' END, CASE WHEN greatest(0, k % 12 - 1) > 8 THEN 'market_fresh' END, CASE WHEN abs(cents - 6400000) * 1000 > 15 * 6400000 THEN 'price_deviation' END,
  CASE WHEN cents % 10 <> 0 OR micro % 10 <> 0 OR micro < 10 THEN 'instrument_precision' END,
  CASE WHEN k % 41 = 0 OR k % 40 = 0 OR cents * micro > least(25, k % 40) * 100000000 THEN 'single_order' END,
  CASE WHEN k % 41 = 0 OR (k % 2 = 0 AND k % 30 * 100000000 < cents * micro) OR (k % 2 = 1 AND micro > 200) THEN 'balance' END,
  CASE WHEN k % 5 >= 3 THEN 'open_orders' END, CASE WHEN k % 6 = 0 THEN 'armed' END, CASE WHEN k % 41 = 0 THEN 'credentials' END) AS failed FROM units)"""


def order_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    signals = _orders(spark, sf_dir).select("o_orderkey", F.element_at(F.array(F.lit("buy"), F.lit("hold"), F.lit("sell"), F.lit("buy")), (k % 4 + 1).cast("int")).alias("action"), ((k % 11) * 1.0 - 1).alias("market_age_s"), ((k % 37) * 10.0).alias("signal_age_s"), (k % 9 != 0).alias("confirmed"), V.price(F.col("o_totalprice")).alias("bid"), V.literal_price("0.1").alias("tick"), V.literal_price("0.00001").alias("lot"), V.literal_price("0.00003").alias("least_size"))
    found = gates.proposals(signals)
    shown = F.col("outcome") == "proposed"
    return found.select("o_orderkey", "outcome", F.when(shown, F.floor(F.col("price") * 10)).cast("long").alias("ticks"), F.when(shown, F.floor(F.col("size") * 100000)).cast("long").alias("lots"))


_PROPOSALS = """rows AS (SELECT o_orderkey, o_orderkey AS k, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) * 10) AS BIGINT) AS ticks FROM orders),
sized AS (SELECT *, CASE WHEN ticks > 0 THEN 10000000 // ticks END AS lots FROM rows),
found AS (SELECT *, CASE WHEN k % 11 - 1 NOT BETWEEN 0 AND 8 THEN 'market_stale' WHEN k % 37 * 10 NOT BETWEEN 0 AND 330 THEN 'signal_stale' WHEN k % 9 = 0 THEN 'not_confirmed' WHEN k % 4 = 1 THEN 'hold' WHEN k % 4 = 2 THEN 'sell_not_supported'
  WHEN coalesce(lots, 0) < 3 THEN 'below_least_size' WHEN ticks * lots > 10000000 THEN 'above_notional' ELSE 'proposed' END AS outcome FROM sized)"""


def model_list_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("model_id"), F.when(F.col("o_orderkey") == 5, "champion").otherwise("validated").alias("state"), F.col("o_orderdate").alias("created_at"))
    return registry.listed(models, 50).select("model_id", "state", stamped("created_at"))


def audit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(_log(spark, sf_dir).select("event_id", "event_type", "ts"), "event_id", state.clamp(500)).select("event_id", "event_type", stamped("ts"))


def champion_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _orders(spark, sf_dir).withColumn("generation", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    last = own.groupBy("o_custkey").agg(F.max("generation").alias("generation"), F.max_by("o_orderkey", "generation").alias("model_id"))
    models = last.select(F.col("o_custkey").alias("scope"), "model_id", F.lit("champion").alias("state"), "generation")
    promotions = own.select(F.col("o_custkey").alias("scope"), "generation", F.col("o_orderdate").alias("promoted_at"))
    kind = F.element_at(F.array(F.lit("promote"), F.lit("rollback"), F.lit("reject")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    decisions = own.select(F.col("o_custkey").alias("scope"), kind.alias("kind"), (F.col("generation") - 1).alias("expected_generation"), F.col("o_orderkey").alias("decision_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("applied_at"))
    return registry.champions(models, promotions, decisions).select("scope", F.col("generation").cast("long").alias("generation"), "model_id", stamped("promoted_at"), "decision_id")


def lease_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases last 12, 60 or 108 hours; a fifth was never applied; model and generation must agree."""
    log = _log(spark, sf_dir).withColumn("model", F.col("user_id") % 50).withColumn("generation", F.col("user_id") % 2)
    leases = log.filter("event_type IN ('signup', 'error')").withColumn("until", F.timestamp_add("HOUR", (F.col("event_id") % 3 * 48 + 12).cast("int"), "ts")).withColumn("applied_at", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    asked = log.filter("event_type = 'purchase'").withColumnRenamed("event_id", "row_id").withColumnRenamed("ts", "asked_at")
    return state.lease_at(asked, leases, ["model", "generation"], "asked_at", "ts", "until", "event_id", "applied_at").select("model", "generation", "row_id", F.col("event_id").alias("lease_id"))


MACHINES = {"position_moves": machines.POSITION, "intent_moves": machines.INTENT, "execution_moves": machines.EXECUTION, "training_moves": machines.TRAINING, "model_moves": registry.MOVES}


def _moves(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Events of seven things a user, named in turn after those of the machine."""
    moves = MACHINES[name]
    events = sorted({e for _, e in moves})
    start = None if any(s is None for s, _ in moves) else "candidate"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        event = F.element_at(F.array(*[F.lit(e) for e in events]), (F.expr("event_id div 7") * 3 % len(events) + 1).cast("int"))
        log = _log(spark, sf_dir).select(F.concat_ws("-", "user_id", F.col("event_id") % 7).alias("thing"), "event_id", event.alias("event"))
        return machines.moved(log, ["thing"], ["event_id"], "event", moves, start)

    return run


#: The same machines written down once more for SQL, by hand from their rules: events in the order of their names, and moves.
_MOVES_SQL = {
    "position_moves": (
        "['attempts_spent', 'entry_filled', 'entry_none', 'exit', 'exit_abandoned', 'exit_all', 'exit_part', 'open', 'review']", 9, "CAST(NULL AS VARCHAR)",
        """(NULL, 'open', 'entry_submitted'), ('entry_submitted', 'entry_filled', 'long'), ('entry_submitted', 'entry_none', 'entry_unfilled'), ('long', 'exit', 'exit_submitted'),
        ('exit_submitted', 'exit_part', 'long'), ('exit_submitted', 'exit_abandoned', 'long'), ('exit_submitted', 'exit_all', 'closed'), ('exit_submitted', 'attempts_spent', 'manual_review'),
        ('entry_submitted', 'review', 'manual_review'), ('long', 'review', 'manual_review'), ('exit_submitted', 'review', 'manual_review')""",
    ),
    "intent_moves": (
        "['accepted', 'allowed', 'blocked', 'claimed', 'credentials', 'ended', 'expired', 'found', 'refused', 'restart', 'reviewed', 'transport', 'unclear']", 13, "CAST(NULL AS VARCHAR)",
        """(NULL, 'allowed', 'previewed'), (NULL, 'refused', 'rejected'), ('previewed', 'refused', 'rejected'), ('previewed', 'expired', 'expired'), ('previewed', 'claimed', 'dispatching'),
        ('dispatching', 'accepted', 'accepted'), ('dispatching', 'refused', 'rejected'), ('dispatching', 'blocked', 'blocked_before_dispatch'), ('dispatching', 'credentials', 'credential_mismatch'),
        ('dispatching', 'transport', 'transport_error'), ('dispatching', 'unclear', 'uncertain'), ('dispatching', 'found', 'reconciled'), ('uncertain', 'found', 'reconciled'),
        ('dispatching', 'restart', 'manual_review'), ('uncertain', 'restart', 'manual_review'), ('manual_review', 'reviewed', 'review_closed'),
        ('accepted', 'ended', 'terminal_verified'), ('reconciled', 'ended', 'terminal_verified'), ('dispatching', 'ended', 'terminal_verified'), ('uncertain', 'ended', 'terminal_verified'), ('manual_review', 'ended', 'terminal_verified')""",
    ),
    "execution_moves": (
        "['claim', 'commit', 'final', 'preview', 'refused', 'unclear']", 6, "CAST(NULL AS VARCHAR)",
        """(NULL, 'claim', 'claimed'), ('claimed', 'preview', 'previewed'), ('claimed', 'refused', 'preview_rejected'), ('previewed', 'commit', 'commit_requested'),
        ('commit_requested', 'final', 'completed'), ('commit_requested', 'unclear', 'manual_review')""",
    ),
    "training_moves": ("['done', 'error', 'restart', 'start']", 4, "CAST(NULL AS VARCHAR)", "(NULL, 'start', 'running'), ('running', 'done', 'completed'), ('running', 'error', 'failed'), ('running', 'restart', 'failed')"),
    "model_moves": (
        "['promote', 'reject', 'retire', 'rollback', 'validate']", 5, "'candidate'",
        "('candidate', 'validate', 'validated'), ('candidate', 'reject', 'rejected'), ('validated', 'promote', 'champion'), ('validated', 'reject', 'rejected'), ('champion', 'retire', 'retired'), ('retired', 'rollback', 'champion')",
    ),
}


def _moves_sql(name: str) -> str:
    events, n, start, known = _MOVES_SQL[name]
    return f"""WITH RECURSIVE m(state, event, after) AS (VALUES {known}),
e AS (SELECT concat(user_id, '-', event_id % 7) AS thing, event_id, {events}[event_id // 7 * 3 % {n} + 1] AS event, row_number() OVER (PARTITION BY concat(user_id, '-', event_id % 7) ORDER BY event_id) AS k FROM events),
run(thing, k, event_id, event, before, after, legal) AS (
  SELECT e.thing, e.k, e.event_id, e.event, {start}, coalesce(m.after, {start}), m.after IS NOT NULL FROM e LEFT JOIN m ON m.state IS NOT DISTINCT FROM {start} AND m.event = e.event WHERE e.k = 1
  UNION ALL SELECT e.thing, e.k, e.event_id, e.event, r.after, coalesce(m.after, r.after), m.after IS NOT NULL FROM run r JOIN e ON e.thing = r.thing AND e.k = r.k + 1 LEFT JOIN m ON m.state IS NOT DISTINCT FROM r.after AND m.event = e.event)
SELECT thing, event_id, event, before, after, legal FROM run"""


position_moves, intent_moves, execution_moves, training_moves, model_moves = map(_moves, MACHINES)


def orders_without_fills_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return _orders(spark, sf_dir).join(fills, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


def orders_with_fills_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return _orders(spark, sf_dir).join(fills, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


def distinct_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.identities(_orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])


def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value")
    return state.latest_versions(log, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def idempotent_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.conflicting_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linestatus", "l_returnflag"])


def insert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"))
    return state.insert_outcomes(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus"), stored, ["o_orderkey"], "o_orderstatus")


def pending_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("client_id"))
    intents = table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("client_id")).distinct()
    return state.matched_orders(orders, intents, "client_id")


def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("entry_submitted", "exit_submitted", "long", "manual_review")]), (k % 4 + 1).cast("int"))
    held = _orders(spark, sf_dir).select(k.alias("position_id"), status.alias("status"), F.when(k % 3 != 0, k).alias("entry_intent_id"), (k + 1).alias("exit_intent_id"))
    names = {"1-URGENT": "rejected", "2-HIGH": "terminal_verified", "3-MEDIUM": "review_closed", "4-NOT SPECIFIED": "accepted"}
    named = F.lit("blocked_before_dispatch")
    for priority, name in names.items():
        named = F.when(F.col("o_orderpriority") == priority, name).otherwise(named)
    intents = _orders(spark, sf_dir).filter("o_orderkey % 5 != 0").select(k.alias("intent_id"), named.alias("intent_status"), F.when(k % 7 != 0, k.cast("string")).alias("commit_key"))
    found = state.recovery(held.withColumn("exit_attempts", F.col("position_id") % 6), intents)
    return found.select("position_id", "status", "outcome", "exit_attempts")


def order_fill_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("filled"), F.col("l_extendedprice").alias("average"), (-F.col("l_tax")).alias("fee"))
    found = positions.fill_accounting(fills, "l_orderkey")
    return found.select("l_orderkey", "fills", F.col("size").cast("double").alias("size"), F.col("proceeds").cast("double").alias("proceeds"), "average")


def _fills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order as a position: its first line is the entry, the others are exits of half of what is owned."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    k = F.col("l_orderkey")
    unit = F.element_at(F.array(F.lit("USDT"), F.lit(" btc "), F.lit("")), (k % 3 + 1).cast("int"))
    numbered = table(spark, sf_dir, "lineitem").withColumn("number", F.row_number().over(order))
    lines = stored(numbered.select("l_orderkey", "number", "l_quantity", "l_extendedprice", "l_tax"), "lines")  # read three times, sorted once
    first = lines.filter("number = 1").select(k.alias("position_id"), F.when(k % 13 == 0, F.col("l_quantity") - 1).otherwise(F.col("l_quantity")).alias("requested"), F.col("l_quantity").alias("filled"), F.col("l_extendedprice").alias("average"), (-F.col("l_tax")).alias("fee"), unit.alias("fee_unit"))
    entered = positions.entries(first)
    size = F.when(k % 7 == 0, F.col("owned")).when(k % 11 == 0, F.col("owned") * 2).otherwise(F.col("owned") / 2)
    exits = lines.filter("number > 1").join(entered.select(F.col("position_id").alias("l_orderkey"), "owned"), "l_orderkey")
    return entered, exits.select(k.alias("position_id"), "number", V.price(size).alias("filled"), F.col("l_extendedprice").alias("average"), F.lit(0).alias("fee"), F.lit("").alias("fee_unit"), "owned")


def entry_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entered, _ = _fills(spark, sf_dir)
    return entered.select("position_id", "status", "reason", *[F.col(c).cast("double").alias(c) for c in ("owned", "cost", "stop_price", "take_price")])


def realised_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = positions.exits(*_fills(spark, sf_dir))
    return done.select("position_id", "status", "reason", F.col("tries").cast("long").alias("tries"), F.col("remaining").cast("double").alias("remaining"), F.col("proceeds").cast("double").alias("proceeds"), r("realised_return").alias("realised_return"))


_ENTRIES = """lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS number FROM lineitem),
first AS (SELECT l_orderkey AS id, CAST(l_quantity AS DECIMAL(18,4)) AS filled, CAST(l_extendedprice AS DECIMAL(18,4)) AS average, CAST(-l_tax AS DECIMAL(18,4)) AS fee FROM lines WHERE number = 1),
entered AS (SELECT id, average, filled + CASE WHEN id % 3 = 1 THEN fee ELSE 0 END AS owned, filled * average - CASE WHEN id % 3 = 0 THEN fee ELSE 0 END AS cost, CASE WHEN id % 13 = 0 THEN 'invalid' ELSE 'long' END AS status FROM first)"""
_EXITS = f"""{_ENTRIES},
fills AS (SELECT l.l_orderkey AS id, l.number, CAST(e.owned * CASE WHEN e.id % 7 = 0 THEN 1 WHEN e.id % 11 = 0 THEN 2 ELSE 0.5 END AS DECIMAL(18,5)) AS filled, CAST(l.l_extendedprice AS DECIMAL(18,4)) AS average FROM lines l JOIN entered e ON e.id = l.l_orderkey WHERE l.number > 1),
run(id, number, status, remaining, proceeds, tries) AS (
  SELECT id, 1, 'long', CAST(owned AS DECIMAL(18,5)), CAST(0 AS DECIMAL(38,9)), 0 FROM entered WHERE status = 'long'
  UNION ALL
  SELECT r.id, r.number + 1, CASE WHEN f.filled > r.remaining THEN 'invalid' WHEN f.filled = r.remaining THEN 'closed' WHEN r.tries + 1 >= 5 THEN 'manual_review' ELSE 'long' END,
    CASE WHEN f.filled > r.remaining THEN r.remaining ELSE r.remaining - f.filled END, CASE WHEN f.filled > r.remaining THEN r.proceeds ELSE CAST(r.proceeds + CAST(f.filled * f.average AS DECIMAL(38,9)) AS DECIMAL(38,9)) END, r.tries + 1
  FROM run r JOIN fills f ON f.id = r.id AND f.number = r.number + 1 WHERE r.status = 'long'),
ended AS (SELECT id, arg_max(status, number) AS status, arg_max(remaining, number) AS remaining, arg_max(proceeds, number) AS proceeds, max(tries) AS tries FROM run GROUP BY id)"""


def daily_entry_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _log(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "ts")
    return state.daily_cap(entries, [], "ts", ["ts", "event_id"], 3).select("event_id", F.col("day").cast("string").alias("day"), F.col("number").cast("long").alias("number"), "accepted")


def permit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _orders(spark, sf_dir).select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    found = state.within_budget(claims, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 3, "600000")
    return found.select("o_custkey", "o_orderkey", "accepted", F.col("used_count").cast("long").alias("used_count"), F.col("used_amount").cast("double").alias("used_amount"))


def state_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_versions(_log(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def fsm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.folded(_log(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type", "observe", ENTRY_MOVES)


def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.transitions(_log(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type", ALLOWED).select("user_id", "event_id", "previous", "event_type")


def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.replays(_log(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "replayed")


def heartbeat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state.sessions(_log(spark, sf_dir), ["user_id"], "ts", 12 * 3600)
    return found.select("user_id", stamped("begin"), stamped("last_beat"), stamped("until"), "beats")


def safety_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("event_type") == "error", "kill").when(F.col("event_type") == "signup", "clear").when(F.col("event_type") == "purchase", "arm")
    log = _log(spark, sf_dir).select("user_id", F.col("ts").alias("at"), names.alias("event"))
    return state.safety_mode(log, ["user_id"], "2024-01-15 00:00:00", 86_400)


def training_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("completed")
    runs = _log(spark, sf_dir).select(F.col("user_id").alias("scope"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.timestamp_add("MINUTE", F.lit(5), "ts").alias("finished_at"), status.alias("status"))
    scopes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope")).union(runs.select("scope")).distinct()
    return state.due_runs(runs, "2024-01-30 12:00:00", scopes=scopes).select("scope", "run_id", "status", "due")


def _audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("user_id", "event_id", V.iso_ms("ts").alias("utc_time"), F.lit("system").alias("actor"), "event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("correlation_id"), F.col("props").alias("payload_json"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.chained(_audit_events(spark, sf_dir), "user_id", "event_id")


def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = _audit(spark, sf_dir).withColumn("event_type", F.when(F.col("event_id") % 500 == 17, "changed").otherwise(F.col("event_type")))
    return integrity.verified(damaged, "user_id", "event_id")


def report_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("dataset"))
    k = F.col("run_id")
    right = left.withColumn("status", F.when(k % 10 == 0, "X").otherwise(F.col("status"))).withColumn("dataset", F.when(k % 15 == 0, F.lit(None).cast("string")).otherwise(F.col("dataset")))
    return integrity.binding_mismatches(left, right, "run_id", ["status", "dataset"]).select("run_id", F.array_join("mismatches", ",").alias("mismatches"))


def redact_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.concat(F.lit('{"who":{"api_key":"x","name":"'), F.col("event_type"), F.lit('"},"props":'), F.col("props"), F.lit(',"X-Signature":1}'))
    return _log(spark, sf_dir).select("event_id", D.redact(payload).alias("payload"))


def position_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", V.price("o_totalprice").alias("price"))
    return integrity.sealed(rows).select("o_orderkey", "row_hash")


def review_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"), F.col("c_mktsegment").alias("scope"), F.lit("validated").alias("state"))
    found = registry.reviews(models, _reports(spark, sf_dir), _summaries(spark, sf_dir))
    return registry.review_pack(found, "scope").select("scope", "evidence_sha256", "pack_id")


_NAMES = "position_moves intent_moves execution_moves training_moves model_moves promotion_gate_reasons shadow_gate_reasons challenger_vs_champion model_reviews risk_checks order_proposals model_list_topk audit_topk champion_promotions lease_asof orders_without_fills_anti orders_with_fills_semi distinct_identities dedup_latest idempotent_conflicts insert_outcomes pending_matched crash_recovery order_fill_accounting entry_positions realised_return daily_entry_cap permit_budget state_latest_version fsm_fold illegal_transitions idempotent_replay heartbeat_sessions safety_mode training_due audit_chain_verify report_binding redact_payload position_seal review_packs"
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_EVENT_ORDER = "(ts, event_id)"
ORACLES = {
    "promotion_gate_reasons": f"WITH {_REPORTS} SELECT model_id, {_PROMOTION} AS reasons FROM reports",
    "shadow_gate_reasons": f"WITH {_REPORTS}, {_SUMMARIES} SELECT model_id, {_SHADOW} AS reasons FROM summaries",
    "challenger_vs_champion": f"""WITH {_REPORTS},
own AS (SELECT model_id % 10 AS scope, model_id, CASE WHEN model_id % 11 <> 0 THEN aggregate_net_return END AS net, max_drawdown AS dd FROM reports)
SELECT a.scope, a.model_id, c.model_id AS champion_id, CASE WHEN a.net IS NULL OR c.net IS NULL OR a.dd IS NULL OR c.dd IS NULL THEN 'champion_comparison_missing'
  ELSE concat_ws(',', CASE WHEN a.net < c.net + 2e-3 THEN 'challenger_oos_improvement_insufficient' END, CASE WHEN a.dd > c.dd + 1e-2 THEN 'challenger_drawdown_regression' END) END AS reasons
FROM own a JOIN own c ON c.scope = a.scope AND c.model_id < 10 WHERE a.model_id >= 30""",
    "model_reviews": f"""WITH {_REPORTS}, {_SUMMARIES},
gate AS (SELECT model_id, {_PROMOTION} AS reasons FROM reports WHERE model_id % 4 <> 0),
shadow AS (SELECT model_id, {_SHADOW} AS reasons FROM summaries WHERE model_id % 3 <> 0)
SELECT c_custkey AS model_id, concat_ws(',', nullif(CASE WHEN g.model_id IS NULL THEN 'validation_missing' ELSE g.reasons END, ''), nullif(CASE WHEN s.model_id IS NULL THEN 'shadow_buys_insufficient,shadow_duration_insufficient,shadow_net_return_not_positive,shadow_drawdown_above_limit' ELSE s.reasons END, '')) AS reasons
FROM customer LEFT JOIN gate g ON g.model_id = c_custkey LEFT JOIN shadow s ON s.model_id = c_custkey""",
    "risk_checks": f"WITH {_RISK} SELECT o_orderkey, failed, failed = '' AS allowed FROM found",
    "order_proposals": f"WITH {_PROPOSALS} SELECT o_orderkey, outcome, CASE WHEN outcome = 'proposed' THEN ticks END AS ticks, CASE WHEN outcome = 'proposed' THEN lots END AS lots FROM found",
    "model_list_topk": f"SELECT o_orderkey AS model_id, CASE WHEN o_orderkey = 5 THEN 'champion' ELSE 'validated' END AS state, {_S('o_orderdate')} AS created_at FROM orders ORDER BY o_orderkey <> 5, o_orderdate DESC, o_orderkey LIMIT 50",
    "audit_topk": f"SELECT event_id, event_type, {_S('ts')} AS ts FROM events ORDER BY event_id DESC LIMIT 200",
    "champion_promotions": f"""WITH own AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS generation FROM orders),
last AS (SELECT o_custkey, max(generation) AS generation FROM own GROUP BY o_custkey)
SELECT o.o_custkey AS scope, o.generation, o.o_orderkey AS model_id, {_S('o.o_orderdate')} AS promoted_at, CASE WHEN o.o_orderkey % 3 < 2 AND o.o_orderkey % 5 <> 0 THEN o.o_orderkey END AS decision_id FROM own o JOIN last l ON l.o_custkey = o.o_custkey AND l.generation = o.generation""",
    "lease_asof": """WITH l AS (SELECT user_id % 50 AS model, user_id % 2 AS generation, event_id, ts, ts + to_hours(CAST(event_id % 3 * 48 + 12 AS INTEGER)) AS until FROM events WHERE event_type IN ('signup', 'error') AND event_id % 5 <> 0)
SELECT a.user_id % 50 AS model, a.user_id % 2 AS generation, a.event_id AS row_id, arg_max(l.event_id, (l.ts, l.event_id)) AS lease_id
FROM events a LEFT JOIN l ON l.model = a.user_id % 50 AND l.generation = a.user_id % 2 AND l.ts <= a.ts AND l.until > a.ts WHERE a.event_type = 'purchase' GROUP BY a.user_id, a.event_id""",
    **{name: _moves_sql(name) for name in MACHINES},
    "orders_without_fills_anti": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)",
    "orders_with_fills_semi": "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "distinct_identities": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "dedup_latest": f"SELECT user_id, event_type, arg_max(event_id, {_EVENT_ORDER}) AS event_id, arg_max(value, {_EVENT_ORDER}) AS value FROM events GROUP BY user_id, event_type",
    "idempotent_conflicts": "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linestatus || '|' || l_returnflag) AS bodies FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus || '|' || l_returnflag) > 1",
    "insert_outcomes": "SELECT o_orderkey, o_orderstatus, CASE WHEN b IS NULL THEN 'inserted' WHEN b = o_orderstatus THEN 'unchanged' ELSE 'conflict' END AS outcome FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS b FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey",
    "pending_matched": """WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), i AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT coalesce(o.k, i.k) AS client_id, CASE WHEN i.k IS NULL THEN 'order_without_intent' WHEN o.k IS NULL THEN 'intent_without_order' ELSE 'matched' END AS outcome FROM o FULL JOIN i ON i.k = o.k""",
    "crash_recovery": """WITH held AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'entry_submitted' WHEN 1 THEN 'exit_submitted' WHEN 2 THEN 'long' ELSE 'manual_review' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END ELSE o_orderkey + 1 END AS intent FROM orders),
intents AS (SELECT o_orderkey AS intent, CASE o_orderpriority WHEN '1-URGENT' THEN 'rejected' WHEN '2-HIGH' THEN 'terminal_verified' WHEN '3-MEDIUM' THEN 'review_closed' WHEN '4-NOT SPECIFIED' THEN 'accepted' ELSE 'blocked_before_dispatch' END AS s, o_orderkey % 7 <> 0 AS committed FROM orders WHERE o_orderkey % 5 <> 0)
SELECT h.id AS position_id, h.status, CASE WHEN h.status IN ('long', 'manual_review') THEN h.status
  WHEN h.status = 'entry_submitted' THEN CASE WHEN h.intent IS NULL OR NOT i.committed OR i.s IN ('rejected', 'blocked_before_dispatch') THEN 'entry_unfilled' WHEN i.s IN ('accepted', 'terminal_verified') THEN h.status ELSE 'manual_review' END
  WHEN NOT i.committed THEN 'long' WHEN i.s IN ('rejected', 'blocked_before_dispatch') THEN CASE WHEN h.id % 6 >= 5 THEN 'manual_review' ELSE 'long' END WHEN i.s IN ('accepted', 'terminal_verified') THEN h.status ELSE 'manual_review' END AS outcome,
  CASE WHEN h.status = 'exit_submitted' AND NOT i.committed THEN greatest(h.id % 6 - 1, 0) ELSE h.id % 6 END AS exit_attempts
FROM held h LEFT JOIN intents i ON i.intent = h.intent""",
    "order_fill_accounting": f"""WITH f AS (SELECT l_orderkey, CAST(l_quantity AS DECIMAL(18,4)) AS q, CAST(l_extendedprice AS DECIMAL(18,4)) AS p, CAST(-l_tax AS DECIMAL(18,4)) AS fee FROM lineitem)
SELECT l_orderkey, count(*) AS fills, CAST(sum(q) AS DOUBLE) AS size, CAST(sum(q * p + fee) AS DOUBLE) AS proceeds, CAST(sum(q * p + fee) AS DOUBLE) / CAST(sum(q) AS DOUBLE) AS average FROM f GROUP BY l_orderkey""",
    "entry_positions": f"""WITH {_ENTRIES} SELECT id AS position_id, status, CASE WHEN status = 'invalid' THEN 'filled_above_requested' END AS reason, CAST(owned AS DOUBLE) AS owned, CAST(cost AS DOUBLE) AS cost,
CASE WHEN status = 'long' THEN CAST(average * 0.985 AS DOUBLE) END AS stop_price, CASE WHEN status = 'long' THEN CAST(average * 1.025 AS DOUBLE) END AS take_price FROM entered""",
    "realised_return": f"""WITH RECURSIVE {_EXITS} SELECT d.id AS position_id, d.status, CASE d.status WHEN 'invalid' THEN 'exit_above_remaining' WHEN 'manual_review' THEN 'exit_attempts_exhausted' END AS reason, CAST(tries AS BIGINT) AS tries, CAST(remaining AS DOUBLE) AS remaining,
CAST(proceeds AS DOUBLE) AS proceeds, CASE WHEN d.status = 'closed' THEN {_R('CAST(proceeds AS DOUBLE) / CAST(e.cost AS DOUBLE) - 1')} END AS realised_return FROM ended d JOIN entered e ON e.id = d.id""",
    "daily_entry_cap": "WITH n AS (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS number FROM events WHERE event_type = 'purchase') SELECT event_id, strftime(day, '%Y-%m-%d') AS day, number, number <= 3 AS accepted FROM n",
    "permit_budget": """WITH RECURSIVE c AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
run(o_custkey, k, o_orderkey, accepted, used_count, used_amount) AS (
  SELECT o_custkey, 1, o_orderkey, amount <= 600000, CAST(amount <= 600000 AS BIGINT), CASE WHEN amount <= 600000 THEN amount ELSE CAST(0 AS DECIMAL(18,2)) END FROM c WHERE k = 1
  UNION ALL SELECT c.o_custkey, c.k, c.o_orderkey, r.used_count < 3 AND r.used_amount + c.amount <= 600000, r.used_count + CAST(r.used_count < 3 AND r.used_amount + c.amount <= 600000 AS BIGINT), CAST(r.used_amount + CASE WHEN r.used_count < 3 AND r.used_amount + c.amount <= 600000 THEN c.amount ELSE 0 END AS DECIMAL(18,2))
  FROM run r JOIN c ON c.o_custkey = r.o_custkey AND c.k = r.k + 1)
SELECT o_custkey, o_orderkey, accepted, used_count, CAST(used_amount AS DOUBLE) AS used_amount FROM run""",
    "state_latest_version": f"SELECT user_id, arg_max(event_type, {_EVENT_ORDER}) AS event_type, arg_max(event_id, {_EVENT_ORDER}) AS event_id FROM events GROUP BY user_id",
    "fsm_fold": """WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
run(user_id, k, state) AS (SELECT user_id, 0, 'observe' FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, CASE WHEN r.state = 'observe' AND e.event_type = 'purchase' THEN 'armed' WHEN r.state = 'armed' AND e.event_type = 'error' THEN 'killed' WHEN r.state = 'armed' AND e.event_type = 'view' THEN 'observe' WHEN r.state = 'killed' AND e.event_type = 'signup' THEN 'observe' ELSE r.state END
  FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, arg_max(state, k) AS state, max(k) AS events FROM run GROUP BY user_id""",
    "illegal_transitions": """WITH m AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT user_id, event_id, previous, event_type FROM m WHERE previous IS DISTINCT FROM event_type AND coalesce(previous, '-') || '>' || event_type NOT IN ('->click', '->view', 'click>view', 'view>click', 'view>purchase', 'purchase>view', 'click>error')""",
    "idempotent_replay": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS replayed FROM events",
    "heartbeat_sessions": f"""WITH m AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL '12 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
SELECT user_id, {_S('min(ts)')} AS begin, {_S('max(ts)')} AS last_beat, {_S("max(ts) + INTERVAL '12 hours'")} AS until, count(*) AS beats FROM s GROUP BY user_id, k""",
    "safety_mode": """WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'error') AS k, max(ts) FILTER (event_type = 'signup') AS c, max(ts) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'error') AS generation FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id)
SELECT user_id, CASE WHEN k IS NOT NULL AND (c IS NULL OR c < k) THEN 'killed' WHEN a + INTERVAL '1 day' > TIMESTAMP '2024-01-15 00:00:00' AND (k IS NULL OR a > k) THEN 'armed' ELSE 'observe' END AS mode, generation FROM s""",
    "training_due": f"""WITH l AS (SELECT user_id, arg_max(event_id, {_EVENT_ORDER}) AS run_id, arg_max(event_type, {_EVENT_ORDER}) AS kind, max(ts) AS ts FROM events GROUP BY user_id)
SELECT s.scope, run_id, CASE kind WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE CASE WHEN kind IS NOT NULL THEN 'completed' END END AS status,
coalesce(ts + INTERVAL '5 minutes' + CASE WHEN kind IN ('error', 'click') THEN INTERVAL '1 hour' ELSE INTERVAL '24 hours' END <= TIMESTAMP '2024-01-30 12:00:00', true) AS due
FROM (SELECT user_id AS scope FROM events UNION SELECT c_custkey FROM customer) s LEFT JOIN l ON l.user_id = s.scope""",
    "audit_chain_verify": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, concat('|', {_S('ts')}, '|system|', event_type, '|', CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) ELSE '' END, '|', props) AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
run(user_id, k, h) AS (SELECT user_id, 0, repeat('0', 64) FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, sha256(r.h || e.body) FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1),
last AS (SELECT user_id, max(k) AS events, arg_max(h, k) AS last_hash FROM run GROUP BY user_id)
SELECT l.user_id, l.events, NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = l.user_id AND x.event_id % 500 = 17) AS valid, l.last_hash FROM last l""",
    "report_binding": "SELECT o_orderkey AS run_id, concat_ws(',', CASE WHEN o_orderkey % 10 = 0 THEN 'status' END, CASE WHEN o_orderkey % 15 = 0 THEN 'dataset' END) AS mismatches FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 15 = 0",
}
