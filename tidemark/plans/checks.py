"""Queries over the smaller rules: value readers, exits and previews, invariants of registers and states, identities of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import features, forward, integrity, machines, positions, registry, research, state
from tidemark.plans import series
from tidemark.plans import sql as Q
from tidemark.sources.bars import table

AS_OF = "2024-01-15 12:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def _pick(place: Column, *texts: str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (place % len(texts) + 1).cast("int"))


def value_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, times and hashes of events, each damaged in some way for a part of the rows."""
    n, text = F.col("event_id"), F.col("event_id").cast("string")
    number = F.when(n % 5 == 0, F.concat(text, F.lit("x"))).when(n % 5 == 1, "").when(n % 5 == 2, F.concat(text, F.lit(".25"))).otherwise(text)
    digest = F.when(n % 3 == 0, F.upper(F.sha2(text, 256))).when(n % 3 == 1, F.sha2(text, 256)).otherwise(F.substring(F.sha2(text, 256), 1, 63))
    second, kinds = F.array(F.lit("a"), F.col("event_type")), F.array(F.col("event_type"), _pick(n, "a", "b", "view"))
    rows = table(spark, sf_dir, "events").withColumn("digest", digest)
    return rows.select(
        "event_id", V.decimal_or_zero(number).cast("double").alias("number"), V.clipped(F.concat(F.lit("  "), "event_type", text), 8).alias("clipped"),
        V.seconds_or_millis(F.when(n % 2 == 0, n + 1_700_000_000).otherwise(n + 1_700_000_000_000)).alias("millis"), V.is_sha256("digest").alias("hashed"),
        series.r(V.percent_change(F.col("value"), (n % 4).cast("double"))).alias("percent"), V.same_keys(second, kinds).alias("same"),
    )


def exit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as held positions with barriers, due a week after their date and a fortnight at the latest."""
    day = lambda n: F.timestamp_add("DAY", F.lit(n), "o_orderdate")
    held = _orders(spark, sf_dir).withColumns({"stop_price": (F.col("o_custkey") * 40).cast("double"), "take_price": (F.col("o_custkey") * 100 + 200_000).cast("double"), "due_at": day(7), "hard_due_at": day(14)})
    return held.select("o_orderkey", positions.exit_reason(F.col("o_totalprice").cast("double"), "1995-06-17 00:00:00").alias("reason"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and views that may still be committed at a time: of an allowed status and not older than two days."""
    seen = _events(spark, sf_dir).select("event_id", state.allowed_status("event_type", ("purchase", "view")).alias("allowed"), state.preview_expired("ts", AS_OF, 2 * 86400).alias("expired"))
    return seen.withColumn("open", F.col("allowed") & ~F.col("expired"))


def pending_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, _ = series._signals(spark, sf_dir)
    some = signals.withColumn("settled_at", F.when(F.col("idx") % 3 != 0, F.col("due_at")))
    return forward.pending(some, AS_OF).select("model_id", series.stamped("due_at"), "signal_id")


def models_without_buy(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"))
    orders = _orders(spark, sf_dir)
    signals = orders.select(F.col("o_custkey").alias("model_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("settled_at"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("action"))
    return forward.without_open_buy(models, signals)


def single_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.single_identity(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


def recovered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the orders as read now, and those of a third as recovered, which count where both are."""
    own = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    again = own.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("R"))
    return state.joined_latest(own.filter("o_orderkey % 2 = 0"), again, "o_orderkey", "seen").select("o_orderkey", "o_orderstatus")


def first_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("decision_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("applied_at"))
    applied = table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 != 0").select(F.col("l_orderkey").alias("decision_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"))
    return registry.applied_first(decisions, applied).select("decision_id", series.stamped("applied_at"))


def champion_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as scopes of models: those that have none or several champions."""
    models = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope"), F.when(F.col("c_custkey") % 40 == 0, "champion").otherwise("validated").alias("state"))
    return registry.not_one_champion(models)


def active_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with several positions that are not at their end, and with orders that may still lead to a fill."""
    k = F.col("o_orderkey")
    held = _orders(spark, sf_dir).select("o_custkey", _pick(k, "long", "closed", "exit_submitted", "entry_unfilled", "manual_review", "closed", "entry_submitted").alias("status"))
    sent = _orders(spark, sf_dir).select("o_custkey", _pick(k, "accepted", "rejected", "uncertain", "terminal_verified", "reconciled", "dispatching", "blocked_before_dispatch", "manual_review").alias("status"))
    active = positions.several_active(held, "o_custkey").withColumnRenamed("count", "active")
    return active.join(machines.several_potential(sent, ["o_custkey"]), "o_custkey", "full_outer").select("o_custkey", "active", "orders")


def observation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of which some have a missing feature, an infinite one, a label of 2 or a return of -1."""
    found = features.observations(series.hourly(spark, sf_dir), chunk=256)
    idx = F.col("idx")
    damaged = found.withColumn("rsi_14", F.when(idx % 31 != 0, F.col("rsi_14"))).withColumn("return_3", F.when(idx % 37 == 0, F.lit(float("inf"))).otherwise(F.col("return_3")))
    damaged = damaged.withColumn("label", F.when(idx % 41 == 0, 2).otherwise(F.col("label"))).withColumn("forward_return", F.when(idx % 43 == 0, -1.0).otherwise(F.col("forward_return")))
    return features.observation_faults(damaged).select(F.col("idx").cast("long").alias("idx"))


def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports over their lines as folds, a part of them with other totals or without folds."""
    folds = table(spark, sf_dir, "lineitem").filter("l_orderkey % 17 != 0").select("l_orderkey", F.col("l_linenumber").cast("long").alias("trades"))
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_linenumber").cast("long")).alias("trades"), F.count("*").alias("folds"))
    report = own.withColumn("trades", F.when(F.col("l_orderkey") % 7 == 0, F.col("trades") + 1).otherwise(F.col("trades"))).withColumn("folds", F.when(F.col("l_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("folds")))
    return research.report_faults(folds, report, ["l_orderkey"])


def dataset_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.dataset_hash(_orders(spark, sf_dir).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


QUERIES = {f.__name__: f for f in (
    value_readers, exit_reasons, previews, pending_signals, models_without_buy, single_identities, recovered_rows, first_applications, champion_faults, active_conflicts,
    observation_checks, report_checks, dataset_hashes,
)}

_S = Q.stamp
ORACLES = {
    "value_readers": """WITH rows AS (
  SELECT *, CAST(event_id AS VARCHAR) AS n, sha256(CAST(event_id AS VARCHAR)) AS h, list_value(event_type, list_value('a', 'b', 'view')[CAST(event_id % 3 + 1 AS INTEGER)]) AS kinds FROM events)
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 0.0 WHEN event_id % 5 = 2 THEN event_id + 0.25 ELSE event_id END::DOUBLE AS number, substr(event_type || n, 1, 8) AS clipped,
  CASE WHEN event_id % 2 = 0 THEN (event_id + 1700000000) * 1000 ELSE event_id + 1700000000000 END AS millis, event_id % 3 = 1 AS hashed,
  CASE WHEN event_id % 4 <> 0 THEN round((value - event_id % 4) / (event_id % 4) * 100.0, 6) + 0.0 END AS percent,
  list_sort(list_distinct(list_value('a', event_type))) = list_sort(list_distinct(kinds)) AS same FROM rows""",
    "exit_reasons": """WITH held AS (SELECT *, CAST(o_totalprice AS DOUBLE) AS last, CAST(o_orderdate AS TIMESTAMP) AS d, TIMESTAMP '1995-06-17' AS now FROM orders)
SELECT o_orderkey, CASE WHEN last <= o_custkey * 40 THEN 'stop' WHEN last >= o_custkey * 100 + 200000 THEN 'take' WHEN now >= d + INTERVAL '14 days' THEN 'hard_due' WHEN now >= d + INTERVAL '7 days' THEN 'due' END AS reason FROM held""",
    "previews": f"""WITH seen AS (SELECT event_id, event_type IN ('purchase', 'view') AS allowed, ts + INTERVAL '2 days' < TIMESTAMP '{AS_OF}' AS expired FROM events)
SELECT *, allowed AND NOT expired AS open FROM seen""",
    "pending_signals": f"WITH RECURSIVE {series._EMIT} SELECT model_id, {_S('due_at')} AS due_at, signal_id FROM signals WHERE idx % 3 = 0 AND due_at <= TIMESTAMP '{AS_OF}'",
    "models_without_buy": "SELECT c_custkey AS model_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0)",
    "single_identities": "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN any_value(l_returnflag) END AS l_returnflag FROM lineitem GROUP BY l_orderkey",
    "recovered_rows": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "first_applications": f"""WITH first AS (SELECT l_orderkey, min(CAST(l_shipdate AS TIMESTAMP)) AS earliest FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT o_orderkey AS decision_id, {_S("CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS TIMESTAMP) ELSE earliest END")} AS applied_at FROM orders LEFT JOIN first ON l_orderkey = o_orderkey""",
    "champion_faults": "SELECT c_nationkey AS scope, count(*) FILTER (c_custkey % 40 = 0) AS champions FROM customer GROUP BY 1 HAVING count(*) FILTER (c_custkey % 40 = 0) <> 1",
    "active_conflicts": """WITH a AS (SELECT o_custkey, count(*) AS active FROM orders WHERE o_orderkey % 7 IN (0, 2, 4, 6) GROUP BY 1 HAVING count(*) > 1),
b AS (SELECT o_custkey, count(*) AS orders FROM orders WHERE o_orderkey % 8 IN (0, 2, 4, 5, 7) GROUP BY 1)
SELECT o_custkey, active, orders FROM a FULL JOIN b USING (o_custkey)""",
    "observation_checks": f"WITH {Q.FEATURES},{Q.LABEL_PARTS} SELECT idx FROM labels JOIN features USING (idx) WHERE idx % 31 = 0 OR idx % 37 = 0 OR idx % 41 = 0 OR idx % 43 = 0",
    "report_checks": """WITH own AS (SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS trades, count(*) AS folds FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN trades + 1 ELSE trades END AS trades, CASE WHEN l_orderkey % 11 <> 0 THEN folds END AS folds FROM own WHERE l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 OR l_orderkey % 17 = 0""",
    "dataset_hashes": """WITH leaf AS (
  SELECT sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":' || CASE WHEN o_orderkey % 3 <> 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || '}') AS h FROM orders),
node AS (SELECT substr(h, 1, 2) AS bucket, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM leaf GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY bucket)) AS dataset_sha256 FROM node""",
}
