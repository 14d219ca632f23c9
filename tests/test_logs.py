"""Compare-and-set, latches, permits, append-only tables: against a plain loop over the log in order."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tidemark.operators import integrity, latches, permits, scans
from tidemark.sources.tables import shared_path
from tidemark.streaming import sinks, streams


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_running_both_ways(spark):
    rng = random.Random(1)
    log = [(rng.choice(["hot", "hot", "a", None]), k, rng.choice([None, 1, 5])) for k in range(400)]
    df = spark.createDataFrame(log, "k string, t int, v int").repartition(7)
    for after in (False, True):
        for inclusive in (False, True):
            got = scans.running(df, ["k"], ["t"], sums={"s": F.col("v")}, lasts={"l": F.col("v")}, after=after, inclusive=inclusive)
            want = []
            for k, t, v in log:
                own = [(u, w) for j, u, w in log if j == k and ((u > t if after else u < t) or (inclusive and u == t))]
                held = [w for _, w in sorted(own, reverse=after) if w is not None]
                want.append((k, t, v, sum(held), held[-1] if held else None))
            assert rows_of(got, "k", "t", "v", "s", "l") == sorted(want, key=repr)


def brute_cas(log, initial):
    now, out = {}, []
    for key, order, expected, new in sorted(log, key=lambda r: r[1]):
        before = now.get(key, initial)
        won = expected is not None and new is not None and expected == before
        now[key] = new if won else before
        out.append((key, order, before, won))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tokens", [2, 7, 60])
def test_compare_and_set(spark, tokens):
    """A hot key, lost races, long chains, values that come back, attempts that set what they expect, nulls."""
    rng = random.Random(tokens)
    value = lambda: rng.choice([None, *range(tokens)])
    log = [(rng.choice(["hot"] * 5 + ["a", "b", None]), k, value(), value()) for k in range(600)]
    df = spark.createDataFrame(log, "k string, t int, expected int, new int").repartition(5)
    got = latches.compare_and_set(df, ["k"], "t", "expected", "new", F.lit(0))
    assert rows_of(got, "k", "t", "before", "won") == brute_cas(log, 0)


def test_generations_race(spark):
    """Three writers try each generation; the first wins, the others and all stale ones lose."""
    log = [("r", 3 * g + w, g - (w == 2), g + 1) for g in range(80) for w in range(3)]
    got = latches.compare_and_set(spark.createDataFrame(log, "k string, t int, expected int, new int"), ["k"], "t", "expected", "new", F.lit(0))
    assert [r.t for r in got.filter("won").orderBy("t").collect()] == [3 * g for g in range(80)]
    assert latches.compare_and_set(spark.createDataFrame([], "k string, t int, expected int, new int"), ["k"], "t", "expected", "new", F.lit(0)).count() == 0


def test_kill_latch(spark):
    rng = random.Random(4)
    log = [(rng.choice("aab"), k, rng.choice(["engage", "engage", "clear", "clear", "clear", "other"]), rng.choice([None, *range(30)]), rng.choice([None, "", "c1", "c2"]), rng.choice([None, "x"])) for k in range(300)]
    state, want = {}, []
    for key, t, event, expected, credential, account in log:
        generation, active, bound = state.get(key, (0, False, (None, None)))
        applied = event == "engage" or (event == "clear" and expected == generation)
        if event == "engage":
            generation, active, bound = generation + 1, True, (credential, account) if credential and account else bound
        elif applied:
            active, bound = False, (None, None)
        state[key] = generation, active, bound
        want.append((key, t, generation, applied, active, *bound))
    df = spark.createDataFrame(log, "k string, t int, event string, expected_generation int, credential string, account string").repartition(4)
    got = latches.kill_latch(df, ["k"], "t")
    assert rows_of(got, "k", "t", "generation", "applied", "active", "bound_credential", "bound_account") == sorted(want, key=repr)
    reviews = spark.createDataFrame([("a", 5), ("a", 5), ("b", 290), ("z", 1)], "k string, t int")
    clears = {k: [t for key, t, event, *_ in log if key == k and (key, t, True) in {(w[0], w[1], w[3]) for w in want} and event == "clear"] for k in "ab"}
    closed = sorted(((r.k, r.t, r.closed_at) for r in latches.cleared_reviews(got, reviews, ["k"], "t").collect()), key=repr)
    first = lambda k, t: next((x for x in clears.get(k, []) if x > t), None)
    assert closed == sorted([("a", 5, first("a", 5)), ("a", 5, first("a", 5)), ("b", 290, first("b", 290)), ("z", 1, None)], key=repr)


def brute_permits(log):
    made, ended, used, claimed, out = {}, set(), {}, set(), []
    for seq, permit, at, kind, body, issued, expires, orders, total, signal, notional in sorted(log):
        n, amount = used.get(permit, (0, Decimal(0)))
        if kind == "register":
            outcome = "registered" if permit not in made else "unchanged" if made[permit] == body else "body_mismatch"
            made.setdefault(permit, body)
        elif kind == "revoke":
            outcome = "permit_missing" if permit not in made else "unchanged" if permit in ended else "revoked"
            if permit in made:
                ended.add(permit)
        elif kind != "claim" or signal is None or notional is None:
            outcome = "invalid"
        elif not issued <= at < expires:
            outcome = "not_valid"
        else:
            if permit not in made and orders > 0 and Decimal(notional) <= Decimal(total):
                made[permit] = body
            if permit in made and made[permit] != body:
                outcome = "body_mismatch"
            elif permit in ended:
                outcome = "revoked"
            elif n >= orders:
                outcome = "orders_exhausted"
            elif amount + Decimal(notional) > Decimal(total):
                outcome = "total_exhausted"
            elif signal in claimed:
                outcome = "already_claimed"
            else:
                outcome, n, amount = "claimed", n + 1, amount + Decimal(notional)
                claimed.add(signal)
        used[permit] = n, amount
        out.append((seq, outcome, n, amount))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_permits(spark, seed):
    """Small and large budgets, signals that several permits claim, revoked and unknown permits, bodies that differ, one hot permit."""
    rng = random.Random(seed)
    log = []
    for seq in range(150):
        permit = rng.choice(["hot", "hot", "p1", "p2", "p3"])
        kind = rng.choice(["claim"] * (9 if seed % 2 else 14) + ["register", "revoke" if rng.random() < 0.3 else "claim", "other" if rng.random() < 0.2 else "claim"])
        terms = {"hot": (30, "40"), "p1": (2, "100"), "p2": (50, "9.5"), "p3": (3, "6")}[permit]
        log.append((seq, permit, rng.randrange(0, 10), kind, rng.choice(["b"] * 12 + ["x", None]), 0, rng.choice([10, 9, 8]), *terms, rng.choice([f"s{rng.randrange(40)}", None if rng.random() < 0.05 else f"t{seq}"]), None if rng.random() < 0.03 else str(rng.choice([1, 2, 0.5, 3.25, 8]))))
    df = spark.createDataFrame(log, "seq int, permit_id string, at int, kind string, body string, issued_at int, expires_at int, max_orders int, max_total string, signal string, notional string").repartition(4)
    got = permits.outcomes(df)
    assert sorted((r.seq, r.outcome, r.used_orders, r.used_total) for r in got.collect()) == brute_permits(log)
    assert got.columns == [*df.columns, "outcome", "used_orders", "used_total"]


PERMITS = "seq int, permit_id string, at int, kind string, body string, issued_at int, expires_at int, max_orders int, max_total string, signal string, notional string"


def permit_log(rng, n, own):
    """Events of permits of which those named own claim signals of their own alone."""
    log = []
    for seq in range(n):
        permit = rng.choice(["hot", "hot", "p1", "p2", *own])
        kind = rng.choice([*["claim"] * 14, "register", "revoke", "other"])
        terms = rng.choice([(30, "40"), (3, "9.5"), (4, "100"), (0, "5")])
        signal = f"{permit if permit in own else 's'}-{rng.randrange(12)}"
        log.append((seq, permit, rng.randrange(0, 10), kind, rng.choice(["b"] * 12 + ["x", None]), 0, rng.choice([10, 9]), *terms, rng.choice([signal] * 9 + [None]), rng.choice(["1", "2", "0.5", "8", None])))
    return log


@pytest.mark.parametrize("long", [permits.LONG, 60])
def test_permits_of_their_own_beside_others(spark, long):
    log = permit_log(random.Random(long), 400, [f"q{k}" for k in range(6)])
    got = permits.outcomes(spark.createDataFrame(log, PERMITS).repartition(4), long)
    assert sorted((r.seq, r.outcome, r.used_orders, r.used_total) for r in got.collect()) == brute_permits(log)


def test_permits_of_their_own_need_no_rounds(spark, monkeypatch):
    log = [r for r in permit_log(random.Random(5), 300, [f"q{k}" for k in range(20)]) if r[1][0] == "q"]
    monkeypatch.setattr(permits, "_settled", None)
    got = permits.outcomes(spark.createDataFrame(log, PERMITS).repartition(4))
    assert sorted((r.seq, r.outcome, r.used_orders, r.used_total) for r in got.collect()) == brute_permits(log)
    big = "123456789012345678901234567890"  # a sum of 38 digits is exact
    rows = [(k, "q", 1, "claim", "b", 0, 9, 9, big, f"s{k}", n) for k, n in enumerate(["100000000000000000000000000000", "0.00000001", big])]
    found = permits.outcomes(spark.createDataFrame(rows, PERMITS)).orderBy("seq").collect()
    assert [r.outcome for r in found] == ["claimed", "claimed", "total_exhausted"] and str(found[2].used_total) == "100000000000000000000000000000.00000001"


def order_rows(spark, rows):
    return spark.createDataFrame(rows, "k long, body string, t int")


def test_append_once(spark):
    """Replays, repeats after a failure, equal and unequal bodies within and across batches, a null key and body."""
    table = sinks.AppendTable(spark, shared_path(spark, "orders"), order_rows(spark, []).schema, ["k"], ["body"], ["t"])
    assert table.rows().count() == table.conflicts().count() == table.ledger().count() == 0
    one = order_rows(spark, [(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, None, 4), (2, "c", 5)])
    two = order_rows(spark, [(None, None, 6), (2, "d", 7), (3, None, 8), (3, "e", 9), (4, "f", 10)])

    class Broken(sinks.AppendTable):
        def _write(self, part, rows, number):
            if part == "ledger":
                raise OSError("lost")
            super()._write(part, rows, number)

    broken = Broken(spark, table.path, table.schema, ["k"], ["body"], ["t"])
    for batch, number in ((one, 0), (two, 1)):
        with pytest.raises(OSError, match="lost"):
            broken.append(batch, number)
        assert table.rows().filter(F.col("batch") == number).count() == 0  # nobody sees half a batch
        table.append(batch, number)
        table.append(batch, number)
    table.append(one.unionByName(two), 2)
    assert rows_of(table.rows(), "k", "body", "t", "batch") == sorted([(1, "a", 1, 0), (None, None, 4, 0), (2, "c", 5, 0), (3, None, 8, 1), (4, "f", 10, 1)], key=repr)
    assert rows_of(table.conflicts(), "k", "t", "batch") == [(1, 3, 0), (1, 3, 2), (2, 7, 1), (2, 7, 2), (3, 9, 1), (3, 9, 2)]
    assert rows_of(table.ledger(), "batch", "inserted", "unchanged", "conflicts") == [(0, 3, 1, 1), (1, 2, 1, 2), (2, 0, 7, 3)]


def test_a_stream_that_fails_goes_on(spark):
    """Files as a stream; the second batch fails once after its rows were written, and the restarted stream gives each row once."""
    folder, state = shared_path(spark, "feed"), shared_path(spark, "feed-state")
    for n in range(3):
        order_rows(spark, [(k, f"b{k}", n) for k in range(n * 2, n * 2 + 4)]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    table = sinks.AppendTable(spark, shared_path(spark, "orders"), order_rows(spark, []).schema, ["k"], ["body"], ["t"])
    feed = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    calls = []

    def once(batch, number):
        calls.append(number)
        if calls.count(1) == 1 and number == 1:
            table._write("rows", batch, number)
            raise OSError("lost")
        table.append(batch, number)

    with pytest.raises(Exception, match="lost"):
        table.drain(feed, state, once)
    table.drain(feed, state, once)
    assert calls == [0, 1, 1, 2] and rows_of(table.rows(), "k", "body") == [(k, f"b{k}") for k in range(8)] and table.conflicts().count() == 0


def test_audit_appends_go_on_from_the_last_hash(spark):
    schema = "user long, n int, utc_time string, actor string, event_type string, correlation_id string, payload_json string"
    events = spark.createDataFrame([(k % 3, k, f"t{k}", "system", "e", None if k % 2 else "c", "{}") for k in range(30)], schema)
    table = sinks.AuditTable(spark, shared_path(spark, "audit"), events.schema, "user", "n")
    for number, part in enumerate(("n < 11", "n < 20", "n >= 11")):  # overlapping batches
        table.append(events.filter(part), number)
        table.append(events.filter(part), number)
    table.append(events.limit(1).withColumn("n", F.lit(-1)), 9)
    want = integrity.chained(events, "user", "n")
    assert rows_of(table.chained_rows(), "user", "n", "event_hash") == rows_of(want, "user", "n", "event_hash")
    assert integrity.chain_breaks(table.chained_rows(), "user", "n").count() == 0 and table.conflicts().count() == 1


def test_shared_folder_is_asked_for_on_clusters(spark):
    assert shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir")) and streams.shared_path is shared_path


def test_chains_stay_whole_over_a_join_that_turns_into_a_broadcast(spark):
    import hashlib

    texts = [(n % 50, n, *[f"{c}{n}" for c in range(5)]) for n in range(3000)]
    schema = f"user long, n long, {', '.join(f'{c} string' for c in integrity.FIELDS)}"
    events = spark.createDataFrame(texts, schema).repartition(8)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        heads = spark.createDataFrame([(u, f"h{u}") for u in range(25)], "user long, head string").repartition(8)
        got = {r.n: r.event_hash for r in integrity.chained(events, "user", "n", heads).collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
    last = {u: f"h{u}" if u < 25 else integrity.GENESIS for u in range(50)}
    for user, n, *own in texts:
        last[user] = hashlib.sha256("|".join([last[user], *own]).encode()).hexdigest()
        assert got[n] == last[user]
