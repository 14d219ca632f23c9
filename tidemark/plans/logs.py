"""Queries over logs and documents: compare-and-set, latches, permits, append-only tables, envelopes, accounts, re-checks, seals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import shapes
from tidemark.functions import values as V
from tidemark.operators import latches, permits, positions, rechecks
from tidemark.operators.features import FEATURES
from tidemark.plans.ledgers import _ENTRIES, _PROMOTION, _REPORTS, _SHADOW, _SUMMARIES, _audit_events, _fills, _log, _orders
from tidemark.plans.sql import rounded
from tidemark.plans.sql import stamp as _S
from tidemark.plans.series import r
from tidemark.sources import accounts, envelopes
from tidemark.sources.bars import table
from tidemark.sources.tables import shared_path, stored
from tidemark.streaming.sinks import AppendTable, AuditTable


def _e() -> Column:
    return F.col("event_id")


def _k() -> Column:
    return F.col("o_orderkey")


def _pick(place: Column, *texts: str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (place % len(texts) + 1).cast("int"))


def cas_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five registers, each with a fifth of the log; an attempt expects one of twenty values and sets another."""
    log = _log(spark, sf_dir).select("event_type", "event_id", (F.col("user_id") % 20).alias("expected"), (_e() % 20).alias("new"))
    return latches.compare_and_set(log, ["event_type"], "event_id", "expected", "new", F.lit(0)).select("event_type", "event_id", "before", "won")


def latch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("event_type") == "error", "engage").when(F.col("event_type") == "signup", "clear").otherwise("other")
    log = _log(spark, sf_dir).select("user_id", "event_id", event.alias("event"), (_e() % 8).alias("expected_generation"), F.when(_e() % 5 != 0, F.concat(F.lit("c"), (_e() % 4).cast("string"))).alias("credential"), F.lit("a").alias("account"))
    return latches.kill_latch(log, ["user_id"], "event_id").select("user_id", "event_id", F.col("generation").cast("long").alias("generation"), "applied", "active", "bound_credential")


def permit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permit for each customer, registered by its first order; claims may repeat a signal, fall outside the permit or come after it was revoked."""
    orders = _orders(spark, sf_dir)
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    kind = F.when(_k() == F.col("first"), "register").when(_k() % 41 == 0, "revoke").when(_k() % 13 == 0, "register").otherwise("claim")
    day = lambda t: F.lit(t).cast("timestamp_ntz")
    log = orders.join(first, "o_custkey").select(
        _k().alias("seq"), F.col("o_custkey").alias("permit_id"), F.col("o_orderdate").alias("at"), kind.alias("kind"), F.when(_k() == F.col("first"), "b").when(_k() % 17 == 0, "x").otherwise("b").alias("body"),
        day("1993-01-01").alias("issued_at"), day("1998-01-01").alias("expires_at"), F.lit(4).alias("max_orders"), F.lit("900000").alias("max_total"), F.concat_ws("-", "o_custkey", _k() % 5).alias("signal"), F.col("o_totalprice").cast("decimal(18,2)").alias("notional"),
    )
    found = permits.outcomes(log)
    return found.select("seq", "outcome", F.col("used_orders").cast("long").alias("used_orders"), F.col("used_total").cast("double").alias("used_total"))


def orders_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three batches, the second one repeated, then all of them again with a tenth changed: nothing is there twice, and what changed is refused."""
    own = stored(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus"), "orders")
    out = AppendTable(spark, shared_path(spark, "append"), own.schema, ["o_orderkey"], ["o_orderstatus"], ["o_orderkey"])
    for number in (0, 1, 2, 1):
        out.append(own.filter(_k() % 3 == number), number)
    out.append(own.withColumn("o_orderstatus", F.when(_k() % 10 == 0, "X").otherwise(F.col("o_orderstatus"))), 3)
    refused = out.conflicts().groupBy("o_orderkey").agg(F.count("*").alias("conflicts"))
    return out.rows().join(refused, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "batch", F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))


def audit_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash chain a user, written in three batches of time, each twice; every batch goes on from the last hashes."""
    events = stored(_audit_events(spark, sf_dir), "audit")
    out = AuditTable(spark, shared_path(spark, "audit-table"), events.schema, "user_id", "event_id")
    thirds = (F.col("utc_time") < "2024-01-11", (F.col("utc_time") >= "2024-01-11") & (F.col("utc_time") < "2024-01-21"), F.col("utc_time") >= "2024-01-21")
    for number, part in enumerate(thirds):
        out.append(events.filter(part), number)
        out.append(events.filter(part), number)
    return out.chained_rows().groupBy("user_id").agg(F.count("*").alias("events"), F.max_by("event_hash", "event_id").alias("last_hash"))


def exits_with_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits of a quarter of what is owned, with fees of either sign in either unit or none."""
    entered, old = _fills(spark, sf_dir)
    lines = old.select("position_id", "number", "average", "owned")
    place = F.col("position_id") + F.col("number")
    fee = F.when(place % 3 == 0, "0").when(F.col("number") % 2 == 0, "0.25").otherwise("-0.25").cast(V.PRICE)
    done = positions.exits(entered, lines.select("position_id", "number", V.price(F.col("owned") / 4).alias("filled"), "average", fee.alias("fee"), _pick(place * 2 + F.col("position_id"), "usdt", "", " BTC", "USDT").alias("fee_unit")))
    return done.select("position_id", "status", "reason", F.col("tries").cast("long").alias("tries"), F.col("remaining").cast("double").alias("remaining"), F.col("proceeds").cast("double").alias("proceeds"), r("realised_return").alias("realised_return"))


def envelopes_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An envelope for each event, most of them damaged in one of ten ways: candles of the sound ones, reasons of the others."""
    n = _e().cast("string")
    row = F.concat(F.lit('["'), n, F.lit('",1,2.5,"3","4","5","6","7","1"]'))
    texts = [
        F.concat(F.lit('{"code":"0","data":['), row, F.lit(","), row, F.lit("]}")), F.concat(F.lit('{"code":0,"data":['), row, F.lit("]}")), F.lit('{"code":"0"}'), F.concat(F.lit('{"code":"0","data":['), row), F.lit("[]"), F.lit('{"data":[]}'),
        F.lit('{"code":true,"data":[]}'), F.concat(F.lit('{"code":"'), n, F.lit('9","data":[]}')), F.lit('{"code":"0","data":{}}'), F.lit('{"code":"0","data":[["1"]]}'), F.concat(F.lit('{"code":"0","data":['), F.replace(row, F.lit("2.5"), F.lit("false")), F.lit("]}")),
    ]
    raw = _log(spark, sf_dir).select("event_id", F.element_at(F.array(*texts), (_e() % len(texts) + 1).cast("int")).alias("text"))
    accepted, quarantine = envelopes.split(raw, "text")
    shown = accepted.select("event_id", F.lit("accepted").alias("place"), F.array_join("fields", ",").alias("what"))
    return shown.unionByName(quarantine.select("event_id", F.lit("quarantine").alias("place"), F.col("reason").alias("what")))


def document_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The props of each event inside a document that is sound or damaged in one of eleven ways."""
    good = F.concat(F.lit('{"props":'), "props", F.lit(',"ok":true,"name":"'), "event_type", F.lit('","w":[1,2.5]}'))
    swap = lambda a, b: F.replace(good, F.lit(a), F.lit(b))
    texts = [
        good, swap('"k": ', '"k": true, "j": '), swap('"k": ', '"k": -'), swap("true", "1"), swap('"ok"', '"no"'), swap("2.5", "false"), F.concat(good, F.lit(" x")), swap('"name":"', '"name":null,"z":"'),
        F.concat(F.lit("["), good, F.lit("]")), swap("[1,2.5]", "3"), swap('},"ok"', ',"ok"'), swap('{"props"', '{"ok":true,"props"'),
    ]
    dealt = _log(spark, sf_dir).select("event_id", "event_type", "props").repartition("event_id")
    raw = dealt.select("event_id", F.element_at(F.array(*texts), (_e() % len(texts) + 1).cast("int")).alias("text"))
    shape = {"props": {"k": "integer"}, "ok": "boolean", "name": "string", "w": "list<number>"}
    return raw.select("event_id", F.array_join(shapes.faults(F.col("text"), shape), ",").alias("faults"))


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account document for each customer with orders, its orders as balances."""
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    one = F.struct(_pick(_k(), "BTC", "USDT", "ETH").alias("ccy"), amount.alias("availBal"), amount.alias("cashBal"), _k().cast("string").alias("eq"))
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(F.to_json(F.struct(F.count("*").cast("string").alias("totalEq"), F.sort_array(F.collect_list(one)).alias("details"))).alias("document"))


def account_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.balances(_accounts(spark, sf_dir), "document")


def balance_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with its last amount in each of two currencies, 0 where it has none or the text is no number."""
    text = F.when(_k() % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("account"), _pick(_k(), "BTC", "USDT", "ETH").alias("currency"), text.alias("available"), "o_orderkey")
    found = accounts.context(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account")), rows, "account", "o_orderkey")
    return found.select("account", F.col("available_usdt").cast("double").alias("available_usdt"), F.col("available_btc").cast("double").alias("available_btc"))


def own_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {c: F.concat(F.lit(f"{c}-"), _k().cast("string")) for c in accounts.ORDER_COLUMNS}
    raw = _orders(spark, sf_dir).select(_pick(F.col("o_custkey"), "own", "other").alias("tag"), *[c.alias(n) for n, c in text.items()], F.col("o_totalprice").alias("secret"))
    return accounts.own_orders(raw, "own", "demo")


def open_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    found = accounts.unresolved_statuses(_orders(spark, sf_dir), status, ["o_custkey"])
    return found.select("o_custkey", "count", F.array_join("statuses", ",").alias("statuses"))


def market_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticker and a snapshot for each order: instrument, price and time; bid, ask, steps and the age of the last close."""
    exact = lambda c: c.cast(V.PRICE)
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = _orders(spark, sf_dir).select(
        "o_orderkey", _pick(_k(), *["X"] * 9, "Y").alias("inst_id"), _pick(_k(), "1.5", "0", "2", "NaN", " 3 ", "-1", "4", "x").alias("last"), (1704067200000 + _k() % 7 * 1000 - 3000).cast("string").alias("ts"), F.lit("X").alias("meta_inst_id"), _pick(_k(), *["SPOT"] * 10, "SWAP").alias("meta_type"),
        day.alias("observed_at"), F.timestamp_add("SECOND", (-(_k() % 400) + 5).cast("int"), day).alias("closed_at"), F.lit("X").alias("instrument"), exact(_k() % 5).alias("bid"), exact(_k() % 6).alias("ask"), F.lit("0.1").cast(V.PRICE).alias("tick"), exact(_k() % 23).alias("lot"), F.when(_k() % 29 != 0, F.lit("1").cast(V.PRICE)).alias("least_size"),
    )
    faults = F.concat(envelopes.ticker_faults("X", "2024-01-01 00:00:00"), envelopes.snapshot_faults("X"))
    return rows.select("o_orderkey", F.array_join(faults, ",").alias("faults"), envelopes.fresh("closed_at", day, 360, -2).alias("fresh"))


def artifact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact for each order, some of them changed after their hash was taken, written with blanks or bound to other features."""
    k = _k().cast("string")
    names = F.when(_k() % 11 == 0, '["b","a"]').otherwise('["a","b"]')
    manifest = F.concat(F.lit('{"code_revision":"r'), k, F.lit('","created_at":"t","dataset_sha256":"d","feature_schema_sha256":"'), F.sha2(F.lit('{"features":["a","b"]}'), 256), F.lit('","model_family":"linear","random_seed":'), (_k() % 100).cast("string"), F.lit(',"trained_from":"t","trained_through":"t","trainer":"w","training_config_sha256":"c","validation_run_id":"v"}'))
    model = F.concat(F.lit('{"buy_threshold":0.6,"coefficients":[1e-05,-2.0],"feature_names":'), names, F.lit(',"intercept":'), (_k() % 50).cast("string"), F.lit('.5,"means":[0.0,1e+16],"scales":[1.0,0.0001],"sell_threshold":0.4}'))
    own = F.concat(F.lit('{"manifest":'), manifest, F.lit(',"model":'), model, F.lit(',"schema_version":"1"}'))
    text = F.when(_k() % 13 == 0, F.replace(own, F.lit('"model":{'), F.lit('"model": {'))).when(_k() % 17 == 0, F.replace(own, F.lit("1e+16"), F.lit("10000000000000000.0"))).otherwise(own)
    # the work is in the rows, of which a file of a few MB has many: they are dealt before it
    rows = _orders(spark, sf_dir).select("o_orderkey").repartition("o_orderkey").select("o_orderkey", text.alias("artifact"), F.when(_k() % 19 == 0, F.sha2(k, 256)).otherwise(F.sha2(text, 256)).alias("sha"), F.when(_k() % 23 == 0, F.lit("{}")).otherwise(manifest).alias("manifest"), F.lit(rechecks.contract_hash(FEATURES)).alias("contract_sha256"))
    return rows.select("o_orderkey", F.array_join(rechecks.artifact_faults("artifact", "sha", "manifest"), ",").alias("faults"), "contract_sha256")


def intent_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intents: previewed, then committed with a few amounts or decisions changed; some were never previewed."""
    part = lambda price, why: _orders(spark, sf_dir).select("o_orderkey", F.struct(F.lit("demo").alias("mode")).alias("authorization"), F.struct(why.alias("why"), (_k() % 3 == 0).alias("allowed")).alias("decision"), F.struct(price.cast("decimal(18,8)").alias("price"), F.col("o_orderpriority").alias("note")).alias("payload"))
    seen = part(F.col("o_totalprice"), F.lit("ok")).filter(_k() % 31 != 0)
    sent = part(F.col("o_totalprice") + F.when(_k() % 20 == 0, 1).otherwise(0), F.when(_k() % 27 == 0, F.lit(None).cast("string")).otherwise("ok"))
    return rechecks.changed_intents(seen, sent, "o_orderkey", ["authorization", "decision", "payload"]).select("o_orderkey", "digest", "outcome")


def decision_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions over events whose stored JSON was changed, or written with a blank, after their id was given."""
    kind = "kind string, n bigint, score double"
    body = F.concat(F.lit('{"kind":"'), "event_type", F.lit('","n":'), _e().cast("string"), F.lit(',"score":0.5}'))
    changed = F.when(_e() % 40 == 0, F.replace(body, F.lit("0.5"), F.lit("0.75"))).when(_e() % 60 == 7, F.lit("broken")).when(_e() % 60 == 8, F.replace(body, F.lit(":0.5"), F.lit(": 0.5"))).otherwise(body)
    from pyspark.sql.types import StructType

    rows = _log(spark, sf_dir).select("event_id", V.content_id("sup_", body, 28).alias("decision_id"), changed.alias("body"))
    return rechecks.forged_decisions(rows, "body", StructType.fromDDL(kind)).select("event_id", "decision_id", "expected_id")


def summary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary a priority of its orders as positions."""
    status = _pick(_k(), "closed", "long", "manual_review", "entry_unfilled")
    rows = _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("scope"), _k().alias("position_id"), status.alias("status"), F.when(status == "closed", _k() % 9 - 4).cast("double").alias("realised_return"))
    return rechecks.summary(rows, "scope", ["position_id"])


_NAMES = "cas_winners latch_states permit_outcomes orders_appended audit_appended exits_with_fees envelopes_split document_faults account_balances balance_pivot own_orders open_statuses market_checks artifact_checks intent_digests decision_checks summary_documents"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in _NAMES.split()}

_LIST = "'[' || CASE WHEN {0} = '' THEN '' ELSE '\"' || replace({0}, ',', '\",\"') || '\"' END || ']'"
ORACLES = {
    "cas_winners": """WITH RECURSIVE e AS (SELECT event_type, event_id, user_id % 20 AS expected, event_id % 20 AS new, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
run(event_type, k, event_id, before, after, won) AS (
  SELECT event_type, k, event_id, CAST(0 AS BIGINT), CASE WHEN expected = 0 THEN new ELSE 0 END, expected = 0 FROM e WHERE k = 1
  UNION ALL SELECT e.event_type, e.k, e.event_id, r.after, CASE WHEN e.expected = r.after THEN e.new ELSE r.after END, e.expected = r.after FROM run r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1)
SELECT event_type, event_id, before, won FROM run""",
    "latch_states": """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'engage' WHEN 'signup' THEN 'clear' ELSE 'other' END AS event, event_id % 8 AS expected, CASE WHEN event_id % 5 <> 0 THEN 'c' || event_id % 4 END AS credential FROM events),
g AS (SELECT *, count(*) FILTER (event = 'engage') OVER (PARTITION BY user_id ORDER BY event_id) AS generation FROM e),
a AS (SELECT *, event = 'engage' OR (event = 'clear' AND generation = expected) AS applied FROM g)
SELECT user_id, event_id, generation, applied, coalesce(last_value(CASE WHEN applied THEN event = 'engage' END IGNORE NULLS) OVER w, false) AS active,
  nullif(last_value(CASE WHEN applied AND event = 'clear' THEN '' WHEN event = 'engage' THEN credential END IGNORE NULLS) OVER w, '') AS bound_credential
FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "permit_outcomes": """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders),
e AS (SELECT o_custkey AS p, k, o_orderkey AS seq, amount, o_orderkey % 5 AS signal, o_orderdate >= DATE '1993-01-01' AND o_orderdate < DATE '1998-01-01' AS valid, k > 1 AND o_orderkey % 17 = 0 AS other,
  CASE WHEN k = 1 THEN 'register' WHEN o_orderkey % 41 = 0 THEN 'revoke' WHEN o_orderkey % 13 = 0 THEN 'register' ELSE 'claim' END AS kind FROM o),
run(p, k, seq, outcome, n, total, ended, signals) AS (
  SELECT p, k, seq, 'registered', CAST(0 AS BIGINT), CAST(0 AS DECIMAL(18,2)), false, CAST([] AS BIGINT[]) FROM e WHERE k = 1
  UNION ALL SELECT p, k, seq, outcome, n + CAST(outcome = 'claimed' AS BIGINT), CAST(total + CASE WHEN outcome = 'claimed' THEN amount ELSE 0 END AS DECIMAL(18,2)), ended OR outcome = 'revoked' AND kind = 'revoke', CASE WHEN outcome = 'claimed' THEN list_append(signals, signal) ELSE signals END
  FROM (SELECT e.p, e.k, e.seq, e.amount, e.signal, e.kind, r.n, r.total, r.ended, r.signals, CASE
    WHEN e.kind = 'register' THEN CASE WHEN e.other THEN 'body_mismatch' ELSE 'unchanged' END WHEN e.kind = 'revoke' THEN CASE WHEN r.ended THEN 'unchanged' ELSE 'revoked' END
    WHEN NOT e.valid THEN 'not_valid' WHEN e.other THEN 'body_mismatch' WHEN r.ended THEN 'revoked' WHEN r.n >= 4 THEN 'orders_exhausted' WHEN r.total + e.amount > 900000 THEN 'total_exhausted' WHEN list_contains(r.signals, e.signal) THEN 'already_claimed' ELSE 'claimed' END AS outcome
    FROM run r JOIN e ON e.p = r.p AND e.k = r.k + 1))
SELECT seq, outcome, n AS used_orders, CAST(total AS DOUBLE) AS used_total FROM run""",
    "orders_appended": "SELECT o_orderkey, o_orderstatus, o_orderkey % 3 AS batch, CAST(o_orderkey % 10 = 0 AS BIGINT) AS conflicts FROM orders",
    "audit_appended": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, concat('|', {_S('ts')}, '|system|', event_type, '|', CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) ELSE '' END, '|', props) AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
run(user_id, k, h) AS (SELECT user_id, 0, repeat('0', 64) FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, sha256(r.h || e.body) FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, max(k) AS events, arg_max(h, k) AS last_hash FROM run GROUP BY user_id""",
    "exits_with_fees": f"""WITH RECURSIVE {_ENTRIES},
fills AS (SELECT l.l_orderkey AS id, l.number, CAST(e.owned * 0.25 AS DECIMAL(18,6)) AS filled, CAST(l.l_extendedprice AS DECIMAL(18,4)) AS average,
  CAST(CASE WHEN (e.id + l.number) % 3 = 0 THEN 0 WHEN l.number % 2 = 0 THEN 0.25 ELSE -0.25 END AS DECIMAL(18,2)) AS fee, ['USDT', '', 'BTC', 'USDT'][((e.id + l.number) * 2 + e.id) % 4 + 1] AS unit FROM lines l JOIN entered e ON e.id = l.l_orderkey WHERE l.number > 1),
run(id, number, status, reason, unit, fees, remaining, proceeds, tries) AS (
  SELECT id, 1, 'long', CAST(NULL AS VARCHAR), '', CAST(0 AS DECIMAL(18,2)), CAST(owned AS DECIMAL(18,6)), CAST(0 AS DECIMAL(38,10)), 0 FROM entered WHERE status = 'long'
  UNION ALL
  SELECT id, number, CASE WHEN wrong IS NOT NULL THEN 'invalid' WHEN debit = remaining THEN 'closed' WHEN tries + 1 >= 5 THEN 'manual_review' ELSE 'long' END, CASE WHEN wrong IS NOT NULL THEN wrong WHEN debit <> remaining AND tries + 1 >= 5 THEN 'exit_attempts_exhausted' END,
    CASE WHEN wrong IS NULL AND unit <> '' THEN unit ELSE held END, CASE WHEN wrong IS NULL THEN CAST(fees + fee AS DECIMAL(18,2)) ELSE fees END, CASE WHEN wrong IS NULL THEN CAST(remaining - debit AS DECIMAL(18,6)) ELSE remaining END, CASE WHEN wrong IS NULL THEN CAST(proceeds + quote AS DECIMAL(38,10)) ELSE proceeds END, tries + 1
  FROM (SELECT *, CASE WHEN debit < 0 OR debit > remaining THEN 'exit_above_remaining' WHEN fee <> 0 AND fees <> 0 AND unit <> '' AND held <> '' AND unit <> held THEN 'fee_unit_changed' WHEN quote < 0 THEN 'fee_invalid' END AS wrong
    FROM (SELECT r.id, r.unit AS held, r.fees, r.remaining, r.proceeds, r.tries, f.number, f.unit, f.fee, f.filled - CASE WHEN f.unit = 'BTC' THEN f.fee ELSE 0 END AS debit, CAST(f.filled * f.average AS DECIMAL(38,10)) + CASE WHEN f.unit = 'USDT' THEN f.fee ELSE 0 END AS quote FROM run r JOIN fills f ON f.id = r.id AND f.number = r.number + 1 WHERE r.status = 'long'))),
ended AS (SELECT id, arg_max(status, number) AS status, max(reason) AS reason, arg_max(remaining, number) AS remaining, arg_max(proceeds, number) AS proceeds, max(tries) AS tries FROM run GROUP BY id)
SELECT d.id AS position_id, d.status, reason, CAST(tries AS BIGINT) AS tries, CAST(remaining AS DOUBLE) AS remaining, CAST(proceeds AS DOUBLE) AS proceeds, CASE WHEN d.status = 'closed' THEN {rounded('CAST(proceeds AS DOUBLE) / CAST(e.cost AS DOUBLE) - 1')} END AS realised_return FROM ended d JOIN entered e ON e.id = d.id""",
    "envelopes_split": """SELECT event_id, CASE WHEN event_id % 11 < 2 THEN 'accepted' ELSE 'quarantine' END AS place, CASE WHEN event_id % 11 < 2 THEN event_id || ',1,2.5,3,4,5,6,7,1'
  ELSE ['not_json', 'not_object', 'code_missing', 'code_missing', 'code_refused', 'data_invalid', 'items_invalid', 'items_invalid'][event_id % 11 - 2] END AS what
FROM events, range(2) AS twice(n) WHERE event_id % 11 <> 2 AND (n = 0 OR event_id % 11 = 0)""",
    "document_faults": """SELECT event_id, ['', 'unexpected:props.j,kind:props.k', '', 'kind:ok', 'unexpected:no,missing:ok', 'kind:w', 'not_json', 'unexpected:z,kind:name', 'not_object', 'kind:w', 'not_json', 'not_json'][event_id % 12 + 1] AS faults FROM events""",
    "account_balances": """SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'BTC' ELSE 'USDT' END AS currency, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS available, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS cash_balance, CAST(o_orderkey AS VARCHAR) AS equity
FROM orders WHERE o_orderkey % 3 < 2""",
    "balance_pivot": """WITH b AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS c, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount FROM orders)
SELECT c_custkey AS account, coalesce(arg_max(amount, o_orderkey) FILTER (c = 1), 0) AS available_usdt, coalesce(arg_max(amount, o_orderkey) FILTER (c = 0), 0) AS available_btc FROM customer LEFT JOIN b ON o_custkey = c_custkey GROUP BY c_custkey""",
    "own_orders": f"SELECT {', '.join(chr(39) + a + '-' + chr(39) + ' || o_orderkey AS ' + chr(34) + b + chr(34) for a, b in (('ordId', 'ordId'), ('clOrdId', 'clOrdId'), ('instId', 'instId'), ('side', 'side'), ('ordType', 'ordType'), ('px', 'price'), ('sz', 'size'), ('accFillSz', 'filledSize'), ('state', 'state'), ('cTime', 'createdAt'), ('uTime', 'updatedAt')))}, 'demo' AS source FROM orders WHERE o_custkey % 2 = 0",
    "open_statuses": "SELECT o_custkey, count(*) AS count, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS statuses FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey",
    "market_checks": """WITH r AS (SELECT o_orderkey, o_orderkey AS k FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN k % 10 = 9 THEN 'instrument_differs' END, CASE WHEN k % 8 IN (1, 3, 5, 7) THEN 'last_invalid' END, CASE WHEN k % 7 = 6 THEN 'time_invalid' END, CASE WHEN k % 11 = 10 THEN 'not_spot' END,
  CASE WHEN k % 400 < 5 THEN 'close_in_future' END, CASE WHEN k % 5 = 0 THEN 'bid_invalid' END, CASE WHEN k % 6 = 0 THEN 'ask_invalid' END, CASE WHEN k % 23 = 0 THEN 'lot_invalid' END, CASE WHEN k % 29 = 0 THEN 'least_size_invalid' END, CASE WHEN k % 5 > k % 6 THEN 'bid_above_ask' END) AS faults,
  k % 400 - 5 BETWEEN -2 AND 360 AS fresh FROM r""",
    "artifact_checks": """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 19 = 0 THEN 'hash_mismatch' END, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'not_canonical' END, CASE WHEN o_orderkey % 11 = 0 THEN 'schema_mismatch' END, CASE WHEN o_orderkey % 23 = 0 THEN 'manifest_mismatch' END) AS faults,
  sha256('{"bar":"5m","evaluation_mode":"long-only-bracket-fixed-horizon-non-overlapping","feature_names":["return_1","return_3","return_12","return_24","return_48","volatility_12","volatility_48","range_1","relative_volume_24","ema_distance_12","ema_distance_48","rsi_14","hour_sin","hour_cos","weekday_sin","weekday_cos"],"label_horizon":12,"stop_loss_fraction":0.015,"take_profit_fraction":0.025,"warmup_bars":48}') AS contract_sha256 FROM orders""",
    "intent_digests": """SELECT o_orderkey, sha256('{"authorization":{"mode":"demo"},"decision":{"allowed":' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END || ',"why":' || CASE WHEN o_orderkey % 27 = 0 THEN 'null' ELSE '"ok"' END || '},"intent":"' || o_orderkey || '","payload":{"note":"' || o_orderpriority || '","price":"'
  || CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,8)) AS VARCHAR) || '"}}') AS digest,
  CASE WHEN o_orderkey % 31 = 0 THEN 'no_preview' WHEN o_orderkey % 20 = 0 OR o_orderkey % 27 = 0 THEN 'changed' ELSE 'same' END AS outcome FROM orders""",
    "decision_checks": """WITH d AS (SELECT event_id, '{"kind":"' || event_type || '","n":' || event_id || ',"score":' AS head FROM events WHERE event_id % 40 = 0 OR event_id % 60 = 7)
SELECT event_id, 'sup_' || left(sha256(head || '0.5}'), 28) AS decision_id, CASE WHEN event_id % 40 = 0 THEN 'sup_' || left(sha256(head || '0.75}'), 28) END AS expected_id FROM d""",
    "summary_documents": """WITH p AS (SELECT o_orderpriority AS scope, o_orderkey AS k, o_orderkey % 4 AS s FROM orders),
a AS (SELECT scope, count(*) AS n, max(k) AS k, count(*) FILTER (s = 0) AS closed, count(*) FILTER (s = 0 AND k % 9 > 4) AS won, max(k % 9 - 4) FILTER (s = 0) AS best, bool_or(s = 1) AS l, bool_or(s = 2) AS m FROM p GROUP BY scope),
d AS (SELECT scope, '{"best":' || best || '.0,"closed":' || closed || ',"latest":{"position_id":' || k || ',"status":"' || ['closed', 'long', 'manual_review', 'entry_unfilled'][k % 4 + 1] || '"},"openStatuses":[' || concat_ws(',', CASE WHEN l THEN '"long"' END, CASE WHEN m THEN '"manual_review"' END) || '],"positions":' || n || ',"won":' || won || '}' AS document FROM a)
SELECT scope, document, sha256(document) AS evidence_sha256 FROM d""",
    # queries of the other modules that had no SQL
    "redact_payload": """SELECT event_id, '{"X-Signature":"[REDACTED]","props":' || replace(props, ' ', '') || ',"who":{"api_key":"[REDACTED]","name":"' || event_type || '"}}' AS payload FROM events""",
    "position_seal": """SELECT o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","price":"' || CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,8)) AS VARCHAR) || '"}') AS row_hash FROM orders""",
    "review_packs": f"""WITH {_REPORTS}, {_SUMMARIES}, gate AS (SELECT model_id, {_PROMOTION} AS reasons FROM reports), shadow AS (SELECT model_id, {_SHADOW} AS reasons FROM summaries),
m AS (SELECT c_mktsegment AS scope, c_custkey AS id, CASE WHEN g.model_id IS NULL THEN 'validation_missing' ELSE g.reasons END AS a, CASE WHEN s.model_id IS NULL THEN 'shadow_buys_insufficient,shadow_duration_insufficient,shadow_net_return_not_positive,shadow_drawdown_above_limit' ELSE s.reasons END AS b
  FROM customer LEFT JOIN gate g ON g.model_id = c_custkey LEFT JOIN shadow s ON s.model_id = c_custkey),
d AS (SELECT scope, '[' || string_agg('{{"model_id":' || id || ',"state":"validated","gate_reasons":' || {_LIST.format('a')} || ',"shadow_reasons":' || {_LIST.format('b')} || '}}', ',' ORDER BY id) || ']' AS document FROM m GROUP BY scope)
SELECT scope, sha256(document) AS evidence_sha256, 'sup_' || left(sha256(document), 28) AS pack_id FROM d""",
}
