"""Greedy runs and compounding over long series, cut into chunks, against plain loops."""

import random

import pytest
from tidemark.operators import research
from pyspark.sql import functions as F


def brute(rows, hold, tail):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        at = 0
        for k, (_, place, action) in enumerate(own[: max(0, len(own) - tail)]):
            if k < at:
                continue
            out.append((key, place, action == "buy"))
            if action == "buy":
                at = k + hold
    return sorted(out)


@pytest.mark.parametrize("hold,tail,chunk,share", [(12, None, 64, 0.3), (12, 0, 5, 0.9), (3, 20, 7, 0.5), (1, 1, 16, 0.5), (40, 3, 8, 0.2), (12, None, 4096, 0.05)])
def test_greedy_runs_over_chunks(spark, hold, tail, chunk, share):
    """Chunks shorter and longer than a hold, tails over several chunks, gaps in the order, slices shorter than a tail."""
    rng = random.Random(hold)
    places = [("long", k) for k in range(700) if k % 11] + [("short", 5 * k) for k in range(30)] + [("tiny", 1), ("tiny", 900)]
    rows = [(m, k, "buy" if rng.random() < share else rng.choice(["hold", None])) for m, k in places]
    df = spark.createDataFrame(rows, "m string, place long, action string").repartition(5)
    got = research.visited(df, ["m"], hold, tail=tail, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == brute(rows, hold, hold if tail is None else tail)


def test_equity_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), k, rng.choice([rng.uniform(-0.05, 0.05), rng.uniform(-0.05, 0.05), 0.0])) for k in range(2000)] + [("z", 0, -2.0), ("z", 1, 0.5), ("n", 0, 0.1)]
    got = {(r.m, r.k): r for r in research.equity(spark.createDataFrame(rows, "m string, k int, net double").repartition(6), ["m"], ["k"]).collect()}
    for key in "abzn":
        equity, peak = 1.0, 1.0
        for m, k, change in rows:
            if m == key:
                equity *= max(0.0, 1 + change)
                peak = max(peak, equity)
                r = got[m, k]
                assert (r.equity, r.peak, r.drawdown) == pytest.approx((equity, peak, (peak - equity) / peak), rel=1e-12, abs=1e-12)
    assert len(got) == len(rows)
    assert research.performance(spark.createDataFrame(rows, "m string, k int, net double"), ["m"], ["k"]).filter("m = 'z'").first().max_drawdown == 1.0


def test_candles_of_a_walk_below_zero(spark, tmp_path):
    import duckdb

    from tidemark.plans import catalog

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(20 * i) AS ts, 1::BIGINT AS user_id, CASE WHEN i % 5 = 0 THEN 'signup' ELSE 'view' END AS event_type, 300.25 + i AS value, '{}' AS props FROM range(200) r(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = catalog.QUERIES["candles_parsed"](spark, str(tmp_path))
    cursor = con.execute(catalog.ORACLES["candles_parsed"])
    want = {tuple(zip(sorted(d[0] for d in cursor.description), [v for _, v in sorted(zip([d[0] for d in cursor.description], r))])) for r in cursor.fetchall()}
    got = {tuple((c, r[c]) for c in sorted(df.columns)) for r in df.collect()}
    assert got == want and min(r.close for r in df.collect()) < 0
