"""Hand-derived results of single operators."""

import datetime as dt
import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import documents, values
from tidemark.operators import features, forward, gates, integrity, machines, positions, research, state
from tidemark.plans import series
from tidemark.sources import bars as B
from tidemark.streaming import streams

START = dt.datetime(2024, 1, 1)


def make_bars(spark, n, minutes=5, change=None):
    rows = []
    for k in range(n):
        close = 50_000.0 + 3 * k
        row = [START + dt.timedelta(minutes=minutes * k), close - 2, close + 5, close - 7, close, 100.0 + k]
        rows.append(change(k, row) if change else row)
    out = spark.createDataFrame([tuple(r) for r in rows], "opened_at timestamp_ntz, open double, high double, low double, close double, volume double")
    return out.withColumn("closed_at", F.timestamp_add("MINUTE", F.lit(minutes), "opened_at"))


def test_fold_plan(spark):
    small = research.Folds(10, 5, 5, 2, 1)
    assert small.gap == 3
    assert [tuple(r) for r in research.plan(spark, 31, small).orderBy("fold").collect()] == [(0, 0, 10, 13, 18), (1, 0, 15, 18, 23), (2, 0, 20, 23, 28)]
    full = research.plan(spark, 9940, research.Folds()).orderBy("fold").collect()
    assert len(full) == 9 and [r.test_start for r in full][:2] == [5013, 5513] and full[-1].test_start == 9013
    with pytest.raises(ValueError):
        research.Folds().count(100)


def test_members_equal_the_plan(spark):
    for spec in (research.Folds(10, 5, 5, 2, 1), research.Folds(10, 5, 5, 2, 1, expanding=False)):
        obs = spark.range(48, 48 + 31).select(F.col("id").alias("idx"))
        got = {(r.fold, r.part, r.place) for r in research.members(obs, 31, spec).collect()}
        want = set()
        for r in research.plan(spark, 31, spec).collect():
            want |= {(r.fold, "train", p) for p in range(r.train_start, r.train_stop)} | {(r.fold, "test", p) for p in range(r.test_start, r.test_stop)}
        assert got == want


def backtest(spark, actions, labels, change, hold, cost):
    rows = [("m", k, a, y, change) for k, (a, y) in enumerate(zip(actions, labels, strict=True))]
    scored = spark.createDataFrame(rows, "model_id string, place long, action string, label int, forward_return double")
    return research.fold_metrics(research.trades(scored, ["model_id"], hold, cost), ["model_id"]).first()


def test_backtest_of_buys(spark):
    r = backtest(spark, ["buy"] * 10, [1] * 10, 0.01, 3, 10.0)
    assert r.trades == 3 and r.gross_return == pytest.approx(1.01**3 - 1) and r.net_return == pytest.approx(1.009**3 - 1) and r.max_drawdown == 0


def test_backtest_of_sells(spark):
    r = backtest(spark, ["sell"] * 20, [0] * 20, -0.01, 3, 10.0)
    assert (r.trades, r.accuracy, r.evaluated, r.net_return) == (0, 1.0, 17, 0.0)


def test_first_loss_counts_as_drawdown(spark):
    r = backtest(spark, ["buy"] * 4, [0] * 4, -0.10, 3, 0.0)
    assert r.max_drawdown == pytest.approx(0.10)


def test_stop_comes_before_target_in_one_bar(spark):
    def wild(k, row):
        return row if k != 49 else [row[0], row[1], 50_144 * 1.03, 50_144 * 0.98, row[4], row[5]]

    first = features.observations(make_bars(spark, 64, change=wild)).orderBy("idx").first()
    assert first.idx == 48 and first.forward_return == -0.015 and first.label == 0


def test_chunks_do_not_change_results(spark):
    bars = make_bars(spark, 400)
    a, b = (features.observations(bars, chunk=c).orderBy("idx").collect() for c in (64, 4096))
    assert a == b and len(a) == 400 - 48 - 12


def test_features_by_hand(spark):
    bars = make_bars(spark, 64)
    r = features.latest(bars).first()
    close = [50_000.0 + 3 * k for k in range(64)]
    ema = close[-12]
    for c in close[-11:]:
        ema = 2 / 13 * c + (1 - 2 / 13) * ema
    changes = [close[k] / close[k - 1] - 1 for k in range(52, 64)]
    assert r.return_48 == pytest.approx(close[-1] / close[-49] - 1) and r.ema_distance_12 == pytest.approx(close[-1] / ema - 1, abs=1e-12)
    assert r.volatility_12 == pytest.approx(np.std(changes)) and r.rsi_14 == 1.0 and r.range_1 == pytest.approx(12 / close[-1])
    assert r.relative_volume_24 == pytest.approx(163 / np.mean([100 + k for k in range(40, 64)])) and features.not_finite(features.features(bars)).count() == 0


def test_several_series_at_once(spark):
    two = make_bars(spark, 80).withColumn("instrument", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = features.observations(two, by=["instrument"], chunk=64)
    assert {r.instrument: r["count"] for r in rows.groupBy("instrument").count().collect()} == {"a": 20, "b": 20}


def test_data_sets_pass_whole_or_not_at_all(spark):
    good = B.parsed(B.raw_candles(make_bars(spark, 64)))
    assert B.validated(good).count() == 64
    with pytest.raises(ValueError, match="not_contiguous"):
        B.validated(good.filter("opened_at != TIMESTAMP_NTZ'2024-01-01 01:00:00'"))
    with pytest.raises(ValueError, match="at least"):
        B.validated(good.limit(10))
    odd = spark.createDataFrame([(["x", "1", "2", "1", "1", "5", "0", "0", "1"],), (["300000", "NaN", "2", "1", "1", "5", "0", "0", "0"],), (["1"],)], "fields array<string>")
    got = [set(r.violations) for r in B.violations(B.parsed(odd)).collect()]
    assert any("time_invalid" in v for v in got) and any({"price_missing", "not_confirmed"} <= v for v in got) and any("width_invalid" in v for v in got)


def test_fits_in_tasks_equal_fits_over_tasks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    rows = [(int(k % 2), k, int(a + 0.3 * b > 0), float(a), float(b)) for k, (a, b) in enumerate(x)]
    table = spark.createDataFrame(rows, "fold int, idx long, label int, u double, v double")
    configs = [research.Config(0.5, 6, 0.01, 0.5, 0.4), research.Config(0.1, 4, 0.1, 0.5, 0.4)]
    near = research.fit(table, configs, ["u", "v"]).orderBy("config", "fold").collect()
    far = research.fit(table, configs, ["u", "v"], task_rows=10).orderBy("config", "fold").collect()
    assert len(near) == 4
    for a, b in zip(near, far, strict=True):
        assert (a.config, a.fold, a.n) == (b.config, b.fold, b.n)
        assert np.allclose([*a.weights, a.intercept, *a.means, *a.scales], [*b.weights, b.intercept, *b.means, *b.scales])


def test_walk_forward_is_repeatable(spark, medium):
    runs = [series.walk_forward_report(spark, medium).orderBy("config").collect() for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 3 and all(r.oos_rows == 400 for r in runs[0])


def position(spark, entry, exits, attempts=5):
    opened = positions.entries(spark.createDataFrame([entry], "position_id string, requested string, filled string, average string, fee string, fee_unit string"))
    table = spark.createDataFrame(exits, "position_id string, number int, filled string, average string, fee string, fee_unit string")
    return positions.exits(opened, table, attempts).first()


def test_fees_in_quote_currency(spark):
    r = position(spark, ("p", "1", "1", "100", "-0.1", "USDT"), [("p", 1, "1", "101", "-0.1", "usdt")])
    assert r.status == "closed" and r.proceeds == Decimal("100.9") and r.realised_return == pytest.approx(100.9 / 100.1 - 1)


def test_fees_in_base_currency_partial_fills_and_faults(spark):
    entry = ("p", "1", "1", "100", "-0.001", "BTC")
    r = position(spark, entry, [("p", 1, "0.5", "102", "-0.001", "BTC"), ("p", 2, "0.498", "104", "0", "")])
    assert r.status == "closed" and r.remaining == 0 and r.exited == Decimal("0.998") and r.tries == 2
    assert position(spark, entry, [("p", 1, "2", "100", "0", "")]).reason == "exit_above_remaining"
    assert position(spark, entry, [("p", k, "0.1", "100", "0", "") for k in range(1, 4)], attempts=3).status == "manual_review"
    assert position(spark, entry, [("other", 1, "1", "1", "0", "")]).status == "long"


def test_order_size_keeps_its_digits(spark):
    row = spark.range(1).select(values.order_size(values.literal_price("10"), values.literal_price("50123.4"), values.literal_price("0.00001")).alias("s"), values.order_size(values.literal_price("10"), values.literal_price("100"), values.literal_price("0.001")).alias("t")).first()
    assert row.s == Decimal("0.00019") and row.t == Decimal("0.1")


def test_forward_test_path_and_summary(spark):
    bars = make_bars(spark, 14, change=lambda k, row: [row[0], 100.0, 103.0 if k == 3 else 100.5, 98.0 if k == 3 else 99.5, 100.0, 1.0])
    signal = bars.limit(1).select(F.lit("s").alias("signal_id"), F.lit("m").alias("model_id"), F.col("closed_at").alias("entry_at"), F.timestamp_add("MINUTE", F.lit(60), "closed_at").alias("due_at"), F.lit("buy").alias("action"), values.literal_price("100").alias("entry_close"))
    done = forward.settled(signal, bars, 300).first()
    assert done.net_return == pytest.approx(-0.0174) and done.exit_step == 3
    assert forward.incomplete(signal, bars.filter("opened_at != TIMESTAMP_NTZ'2024-01-01 00:20:00'"), 300, "2024-01-02 00:00:00").first().missing == 1
    two = spark.createDataFrame([("a", "m", START, START, "buy", 0.099), ("b", "m", START, START + dt.timedelta(days=1), "sell", 0.0)], "signal_id string, model_id string, entry_at timestamp_ntz, settled_at timestamp_ntz, action string, net_return double")
    r = forward.summary(two).first()
    assert (r.settled_signals, r.settled_buys, r.duration_days) == (2, 1, 1.0) and r.net_return == pytest.approx(0.099)


def test_streams_equal_batches(spark, medium):
    batch = {(r.model_id, r.net_return) for r in series.shadow_settle(spark, medium).collect()}
    stream = {(r.series, r.net_return) for r in series.stream_settle(spark, medium).collect()}
    assert batch == stream


def test_state_is_kept_between_batches(spark, tmp_path):
    rows = [("s", k, 100.0 + k, 99.0 + k, 99.5 + k, k == 0) for k in range(20)]
    table = spark.createDataFrame(rows, "series string, idx long, high double, low double, close double, buy boolean")
    for part in ("idx < 5", "idx >= 5"):
        table.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    (r,) = streams.collected(streams.settled(feed, hold=12, take=0.1), "state").collect()
    assert (r.entry_idx, r.exit_close) == (0, pytest.approx(99.5 * 1.1))


def test_tampering_breaks_a_chain(spark):
    rows = [("c", k, f"t{k}", "system", "x", None if k % 2 else "id", "{}") for k in range(6)]
    events = spark.createDataFrame(rows, "chain string, id long, utc_time string, actor string, event_type string, correlation_id string, payload_json string")
    chain = integrity.chained(events, "chain", "id").persist()
    assert integrity.verified(chain, "chain", "id").first().valid
    for column in ("utc_time", "payload_json", "event_hash", "previous_hash"):
        bad = chain.withColumn(column, F.when(F.col("id") == 3, "z").otherwise(F.col(column)))
        assert not integrity.verified(bad, "chain", "id").first().valid
    assert not integrity.verified(chain.filter("id != 2"), "chain", "id").first().valid


def test_seals_and_documents(spark):
    rows = spark.createDataFrame([(1, "ü", 0.00001), (2, None, 1e7)], "k int, s string, x double")
    whole = integrity.sealed(rows)
    assert integrity.seal_mismatches(whole).count() == 0
    assert integrity.seal_mismatches(whole.withColumn("s", F.lit("other"))).count() == 2
    row = spark.range(1).select(documents.canonical_json(F.lit('{"b": 1e-05, "a": [1, "ü"]}')).alias("c"), documents.redact(F.lit('{"X":{"Api_Key":"k","n":[{"passphrase":1}]}}')).alias("r")).first()
    assert row.c == '{"a":[1,"ü"],"b":1e-05}' and json.loads(row.r) == {"X": {"Api_Key": "[REDACTED]", "n": [{"passphrase": "[REDACTED]"}]}}


def test_stale_generation_and_idempotent_inserts(spark):
    log = spark.createDataFrame([("m", 1), ("m", 2), ("m", 2)], "scope string, generation int")
    assert [r.generation for r in state.generation_conflicts(log, ["scope"]).collect()] == [2]
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, body string")
    fresh = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, body string")
    assert {r.k: r.outcome for r in state.insert_outcomes(fresh, stored, ["k"], "body").collect()} == {1: "unchanged", 2: "conflict", 3: "inserted"}
    assert [r.k for r in state.new_only(fresh, stored, ["k"], ["body"]).collect()] == [3]


def test_gates_and_risk(spark):
    report = spark.createDataFrame([(True, 9, 4500, 25, 24.0, 0.6, 0.01, -0.01, 0.05)], "supported boolean, folds int, oos_rows int, trades int, cost_bps double, aggregate_accuracy double, aggregate_net_return double, worst_fold_net_return double, max_drawdown double")
    assert report.select(gates.promotion_reasons().alias("r")).first().r == []
    summary = spark.createDataFrame([(25, 8.0, 0.0, None)], "settled_buys int, duration_days double, net_return double, max_drawdown double")
    assert summary.select(gates.shadow_reasons().alias("r")).first().r == ["shadow_net_return_not_positive", "shadow_drawdown_above_limit"]


def test_flags_are_strict(spark):
    assert spark.range(1).select(values.strict_flag(F.lit("true")).alias("f")).first().f is True
    with pytest.raises(Exception, match="not a flag"):
        spark.range(1).select(values.strict_flag(F.lit("yes")).alias("f")).collect()


def test_the_rest_works_without_the_training_data_folder(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 60
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("intent,key,entry,exit_", [
    ("accepted", "k", "entry_submitted", "exit_submitted"), ("reconciled", "k", "entry_submitted", "exit_submitted"), ("terminal_verified", "k", "entry_submitted", "exit_submitted"),
    ("review_closed", "k", "manual_review", "manual_review"), ("uncertain", "k", "manual_review", "manual_review"), ("dispatching", "k", "manual_review", "manual_review"),
    ("blocked_before_dispatch", "k", "entry_unfilled", "long"), ("rejected", "k", "entry_unfilled", "long"), ("previewed", None, "entry_unfilled", "long"), ("previewed", "", "entry_unfilled", "long"), (None, None, "manual_review", "manual_review"),
])
def test_recovery_of_each_intent_status(spark, intent, key, entry, exit_):
    held = spark.createDataFrame([("e", "entry_submitted", "i", None, 0), ("x", "exit_submitted", None, "i", 4), ("last", "exit_submitted", None, "i", 5), ("none", "entry_submitted", None, None, 0), ("lost", "exit_submitted", None, None, 1), ("l", "long", "i", None, 0), ("m", "manual_review", "i", None, 0)], "position_id string, status string, entry_intent_id string, exit_intent_id string, exit_attempts int")
    intents = spark.createDataFrame([("i", intent, key)] if intent else [], "intent_id string, intent_status string, commit_key string")
    got = {r.position_id: (r.outcome, r.exit_attempts) for r in state.recovery(held, intents).collect()}
    unsent = intent is not None and not key
    refused = intent in state.NOTHING_SENT
    assert got["e"] == (entry, 0) and got["x"] == (exit_, 3 if unsent else 4)
    assert got["last"] == ("manual_review" if refused else exit_, 4 if unsent else 5)
    assert got["none"] == ("entry_unfilled", 0) and got["lost"] == ("manual_review", 1) and got["l"] == ("long", 0) and got["m"] == ("manual_review", 0)


def test_training_is_due(spark):
    runs = [("done", 1, "2024-01-01 00:00:00", "2024-01-01 01:00:00", "completed"), ("failed", 2, "2024-01-01 00:00:00", "2024-01-01 01:00:00", "failed"), ("runs", 3, "2024-01-01 00:00:00", None, "running"), ("just", 4, "2024-01-01 01:30:00", None, "running")]
    table = spark.createDataFrame(runs, "scope string, run_id long, started_at string, finished_at string, status string").selectExpr("scope", "run_id", "cast(started_at AS timestamp_ntz) AS started_at", "cast(finished_at AS timestamp_ntz) AS finished_at", "status")
    scopes = spark.createDataFrame([(s,) for s in ("done", "failed", "runs", "just", "never")], "scope string")
    due = lambda at: {r.scope for r in state.due_runs(table, at, scopes=scopes).filter("due").collect()}
    assert due("2024-01-01 02:00:00") == {"failed", "runs", "never"} and due("2024-01-02 01:00:00") == {"done", "failed", "runs", "just", "never"}


def test_an_expired_newer_lease_does_not_hide_an_older_one(spark):
    leases = [("m", 1, "a", 0, 100, 0), ("m", 1, "b", 10, 20, 1), ("m", 1, "c", 12, 40, None), ("m", 2, "d", 0, 99, 0), ("m", 1, "e", 50, 60, 50)]
    stamp = lambda c: f"cast(timestampadd(MINUTE, {c}, timestamp'2024-01-01') AS timestamp_ntz) AS {c}"
    table = spark.createDataFrame(leases, "model string, generation int, lease_id string, issued int, until int, applied int").selectExpr("model", "generation", "lease_id", stamp("issued"), stamp("until"), stamp("applied"))
    asked = spark.createDataFrame([("m", 1, k, k) for k in (0, 10, 15, 20, 55, 60, 100)] + [("m", 3, 200, 15)], "model string, generation int, row_id int, at int").selectExpr("model", "generation", "row_id", stamp("at"))
    got = {r.row_id: r.lease_id for r in state.lease_at(asked, table, ["model", "generation"], "at", "issued", "until", "lease_id", "applied").collect()}
    assert got == {0: "a", 10: "b", 15: "b", 20: "a", 55: "e", 60: "a", 100: None, 200: None}


def test_faults_of_exits(spark):
    entry = ("p", "1", "1", "100", "0", "")
    assert position(spark, entry, [("p", 1, "0.5", "101", "-0.1", "USDT"), ("p", 2, "0.2", "101", "-0.1", "BTC")]).reason == "fee_unit_changed"
    assert position(spark, entry, [("p", 1, "0.5", "0", "0", "")]).reason == "average_missing"
    fills = lambda *fees: [("p", k, "0.25", "101", *fee) for k, fee in enumerate(fees)]
    # a fill without fee still names the unit that the next one is held against, and fees that cancel out free the unit
    assert position(spark, entry, fills(("-0.1", "USDT"), ("0", "BTC"), ("-0.1", "USDT"))).reason == "fee_unit_changed"
    assert position(spark, entry, fills(("-0.1", "USDT"), ("0.1", "USDT"), ("-0.1", "BTC"))).reason is None
    assert position(spark, entry, fills(("-0.1", "USDT"), ("0", ""), ("-0.1", "BTC"))).reason == "fee_unit_changed"


def test_exits_are_plain_columns(spark):
    """The fold is no aggregate by a lambda, which Spark would interpret; as many steps as attempts give what a fold gives."""
    entry = ("p", "1", "1", "100", "0", "")
    fills = [("p", k, "0.1", "101", "0", "") for k in range(8)]
    for attempts, left in ((1, "0.9"), (3, "0.7"), (5, "0.5")):
        r = position(spark, entry, fills, attempts)
        assert (r.status, r.reason, r.tries, r.remaining) == ("manual_review", "exit_attempts_exhausted", attempts, Decimal(left))
    r = position(spark, entry, fills[:2])
    assert (r.status, r.reason, r.tries, r.exited) == ("long", None, 2, Decimal("0.2"))
    opened = positions.entries(spark.createDataFrame([entry], "position_id string, requested string, filled string, average string, fee string, fee_unit string"))
    table = spark.createDataFrame(fills, "position_id string, number int, filled string, average string, fee string, fee_unit string")
    assert "aggregate(" not in positions.exits(opened, table)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name,path,end", [
    ("INTENT", "allowed claimed ended", "terminal_verified"), ("INTENT", "allowed claimed unclear ended", "terminal_verified"), ("INTENT", "allowed claimed unclear restart ended", "terminal_verified"),
    ("INTENT", "allowed claimed accepted ended", "terminal_verified"), ("INTENT", "allowed claimed unclear found ended", "terminal_verified"), ("INTENT", "allowed ended", "previewed"),
    ("INTENT", "allowed claimed restart reviewed ended", "review_closed"), ("INTENT", "allowed expired claimed", "expired"), ("EXECUTION", "claim preview commit unclear final", "manual_review"),
    ("EXECUTION", "claim refused preview", "preview_rejected"), ("POSITION", "open entry_filled exit exit_part exit exit_all open", "closed"), ("POSITION", "open entry_none exit", "entry_unfilled"), ("TRAINING", "start restart done", "failed"),
])
def test_moves(spark, name, path, end):
    log = spark.createDataFrame([("x", k, e) for k, e in enumerate(path.split())], "thing string, k int, event string")
    assert machines.moved(log, ["thing"], ["k"], "event", getattr(machines, name)).orderBy("k").collect()[-1].after == end


def test_active_positions(spark):
    table = spark.createDataFrame([("a", "closed_dust"), ("a", "long"), ("b", "long"), ("b", "manual_review"), ("c", "closed"), ("c", "entry_unfilled")], "scope string, status string")
    assert [r.scope for r in positions.several_active(table, "scope").collect()] == ["b"]
