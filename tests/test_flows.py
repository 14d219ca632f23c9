from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import late, streams, timers
from tidemark.sources.tables import shared_path

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def modes(spark, parts, ttl=600, delay="30 minutes"):
    rows = [(k, at(m), n, e, p) for p, part in enumerate(parts) for k, m, n, e in part]
    rows.append((None, at(100_000), None, timers.MARK, len(parts)))
    log = spark.createDataFrame(rows, "k string, at timestamp_ntz, event_id long, event string, part int").coalesce(1)
    stream = streams.read_files(spark, streams.feed(log, "part", len(parts) + 1, "modes"), 1)
    found = streams.collected(timers.safety_modes(stream, "k", ttl, delay), "modes", store=streams.ROCKS)
    return sorted(((r.k, (r.at - int(START.timestamp() * 1e6)) / 60e6, r.event_id, r.mode, r.generation) for r in found.collect()), key=lambda r: (r[0] or "", r[1], r[2] or 0))


def test_modes_with_rows_out_of_order(spark):
    before = spark.conf.get(streams.STORE, None)
    parts = [[("a", 0, 1, "arm"), ("a", 20, 4, "arm"), ("b", 5, 7, "kill")], [("a", 4, 2, "other"), ("a", 25, 5, "kill")], [("b", 6, 8, "arm"), ("a", 15, 3, "other"), ("b", 7, 9, "clear")]]
    assert modes(spark, parts) == [
        ("a", 0, 1, "armed", 0), ("a", 4, 2, "armed", 0), ("a", 10, None, "observe", 0), ("a", 15, 3, "observe", 0), ("a", 20, 4, "armed", 0), ("a", 25, 5, "killed", 1),
        ("b", 5, 7, "killed", 1), ("b", 6, 8, "killed", 1), ("b", 7, 9, "armed", 1), ("b", 16, None, "observe", 1),
    ]
    assert spark.conf.get(streams.STORE, None) == before


def test_rows_behind_the_watermark_change_no_mode(spark):
    parts = [[("a", 0, 1, "arm")], [("a", 200, 2, "other")], [("c", 201, 3, "other")], [("a", 1, 4, "kill")]]
    found = modes(spark, parts, delay="1 minute")
    assert found == [("a", 0, 1, "armed", 0), ("a", 10, None, "observe", 0), ("a", 200, 2, "observe", 0), ("c", 201, 3, "observe", 0)]


def test_keys_of_a_bucket_keep_their_own_latches(spark):
    """Calls and state are a bucket's, not a key's; null keys and numbers that a double doesn't hold are among them."""
    big = (1 << 53) + 1
    keys = [None, *range(big, big + 300)]
    rows = [(k, at(m), n, e, p) for k in keys for m, n, e, p in ((0, big, "arm", 0), (30, None, "other", 1), (20, 2, "kill" if k and k % 2 else "arm", 1))]
    rows.append((None, at(100_000), None, timers.MARK, 2))
    log = spark.createDataFrame(rows, "k long, at timestamp_ntz, event_id long, event string, part int").coalesce(1)
    stream = streams.read_files(spark, streams.feed(log, "part", 3, "modes"), 1)
    found = streams.collected(timers.safety_modes(stream, "k", 600, "30 minutes", buckets=4), "modes", store=streams.ROCKS).collect()
    start = int(START.timestamp() * 1e6)
    by = {}
    for r in found:
        by.setdefault(r.k, []).append(((r.at - start) // 60_000_000, r.event_id, r.mode, r.generation))
    begun = [(0, big, "armed", 0), (10, None, "observe", 0)]
    one, two = [*begun, (20, 2, "killed", 1), (30, None, "killed", 1)], [*begun, (20, 2, "armed", 0), (30, None, "observe", 0), (30, None, "observe", 0)]
    assert set(by) == set(keys) and all(sorted(v, key=lambda r: r[0]) == (one if k and k % 2 else two) for k, v in by.items())


SCHEMA = "n long, at timestamp_ntz"


def split(out):
    return sorted(r.n for r in out.on_time().collect()), sorted(r.n for r in out.late().collect())


def test_late_rows_are_judged_by_earlier_batches(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    out = late.LateTable(spark, shared_path(spark, "late"), frame([]).schema, "at", 600)
    out.append(frame([]), 0)
    assert split(out) == ([], [])
    out.append(frame([(1, at(60)), (2, at(0)), (3, None)]), 1)  # rows of one batch are never late for each other
    out.append(frame([(4, at(49)), (5, at(50)), (6, at(61))]), 2)
    out.append(frame([(7, at(500))]), 2)  # the ledger has this batch
    assert split(out) == ([1, 2, 5, 6], [3, 4])
    assert [tuple(r) for r in out.ledger().filter("batch = 2").select("on_time", "late").collect()] == [(2, 1)]
    what = {"volume": F.count("*"), "last": F.max("n")}
    found = late.reopened(out.on_time(), out.late(), F.date_trunc("hour", "at").cast("timestamp_ntz"), what).collect()
    assert [(r.bar, r.first_volume, r.volume, r.first_last, r.last, r.late_rows) for r in found] == [(at(0), 2, 3, 5, 5, 1)]


def test_a_batch_that_failed_is_judged_as_at_first(spark):
    class Failing(late.LateTable):
        broken = True

        def _write(self, part, rows, number):
            if part == "ledger" and self.broken:
                raise OSError("lost")
            super()._write(part, rows, number)

    rows = spark.createDataFrame([(1, at(60), 0), (2, at(10), 1), (3, at(70), 1)], f"{SCHEMA}, part int").coalesce(1)
    stream = lambda: streams.read_files(spark, folder, 1)
    folder, state = streams.feed(rows, "part", 2, "late-feed"), shared_path(spark, "late-state")
    out = Failing(spark, shared_path(spark, "late"), spark.createDataFrame([], SCHEMA).schema, "at", 600)
    try:
        out.drain(stream(), state)
    except Exception:
        assert split(out) == ([], [])
    out.broken = False
    out.drain(stream(), state)
    assert split(out) == ([1, 3], [2])


def test_steps_without_a_bar_come_out_once(spark):
    wanted = spark.createDataFrame([("s", k, at(5 * k), 0) for k in range(1, 5)] + [("t", 1, at(5), 1), ("", 0, at(100_000), 2)], "signal_id string, step int, closed_at timestamp_ntz, part int").coalesce(1)
    bars = spark.createDataFrame([(at(10), 2.0, 0), (at(5), 1.0, 1), (at(20), 4.0, 1), (at(100_000), 0.0, 2)], "closed_at timestamp_ntz, close double, part int").withColumns({"high": F.col("close"), "low": F.col("close")}).coalesce(1)
    read = lambda df: streams.read_files(spark, streams.feed(df, "part", 3, "steps"), 1)
    found = streams.collected(streams.with_paths(read(wanted), read(bars), "1 hour"), "steps").filter("signal_id != ''")
    assert sorted((r.signal_id, r.step, r.close, r.there) for r in found.collect()) == [("s", 1, 1.0, True), ("s", 2, 2.0, True), ("s", 3, None, False), ("s", 4, 4.0, True), ("t", 1, 1.0, True)]
