"""Safety modes as a stream with event-time timers: an arming runs out by itself, without any event that says so.

Events may come in any order that the watermark allows: those ahead of it wait in state, and each is taken when it has
passed them, in order of time. Every call of a processor and every reading of state costs milliseconds, so keys are dealt into
buckets by hash and a bucket's keys share calls, state and timer: what waits lies there as Arrow tables, one a batch, and the
latches of its keys as one. State is the events that wait and six numbers a key, so it grows with the watermark's
delay and the keys, not with the log; events behind the watermark are late and dropped (see streaming.late for a side table).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NEVER = -(1 << 62)
#: An event that only moves the watermark on.
MARK = "mark"
#: Buckets that keys are dealt into. One is read whole when its timer is due: 16 bytes and the key's text for each event that waits.
BUCKETS = 512

_WAITING = pa.schema([("key", pa.string()), ("at", pa.int64()), ("event_id", pa.int64()), ("numbered", pa.bool_()), ("event", pa.string())])
_LATCHES = pa.schema([("key", pa.string()), *[(n, pa.int64()) for n in ("killed", "cleared", "armed", "until", "generation")]])
_FRESH = (NEVER, NEVER, NEVER, NEVER, 0)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


class _Modes(StatefulProcessor):
    def __init__(self, ttl_micros: int):
        self.ttl = ttl_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.latches = handle.getValueState("latches", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [part[part["event"] != MARK] for part in rows]
        found = pa.concat_tables([pa.Table.from_pandas(part[_WAITING.names], schema=_WAITING, preserve_index=False) for part in parts if len(part)] or [_WAITING.empty_table()])
        if len(found):
            self.waiting.appendValue((_packed(found),))
            self.handle.registerTimer(_due(pc.min(found["at"]).as_py()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = pa.concat_tables([_WAITING.empty_table(), *[_unpacked(body) for (body,) in self.waiting.get()]])
        known = _unpacked(self.latches.get()[0]) if self.latches.exists() else _LATCHES.empty_table()
        if not len(events) and not pc.any(pc.and_(pc.not_equal(known["until"], NEVER), pc.less_equal(known["until"], now))).as_py():
            return
        passed = pc.less_equal(events["at"], now)
        ready, rest = events.filter(passed), events.filter(pc.invert(passed))
        if len(ready):
            self.waiting.put([(_packed(rest.combine_chunks()),)]) if len(rest) else self.waiting.clear()
        latches = {k: tuple(v) for k, *v in zip(*[c.to_pylist() for c in known.columns], strict=True)}
        own: dict[str | None, list[tuple]] = {k: [] for k, v in latches.items() if NEVER != v[3] <= now}
        for k, at, number, numbered, event in zip(*[c.to_pylist() for c in ready.columns], strict=True):
            own.setdefault(k, []).append((at, number if numbered else None, event))
        out: list[tuple] = []
        for k, log in own.items():
            latches[k] = self._fold(k, latches.get(k, _FRESH), sorted(log) if len(log) > 1 else log, now, out)
        if own:
            columns = zip(*[(k, *v) for k, v in latches.items()], strict=True)
            self.latches.update((_packed(pa.table([pa.array(c, f.type) for c, f in zip(columns, _LATCHES, strict=True)], schema=_LATCHES)),))
        later = [v[3] for v in latches.values() if v[3] != NEVER] + ([pc.min(rest["at"]).as_py()] if len(rest) else [])
        if later:
            self.handle.registerTimer(_due(min(later)))
        if out:
            found = pd.DataFrame(out, columns=["key", "at", "event_id", "mode", "generation"], dtype=object)
            yield found.astype({"at": "int64", "event_id": "Int64", "generation": "int64"})

    def _fold(self, key: str | None, latch: tuple, log: list[tuple], now: int, out: list[tuple]) -> tuple:
        """The latch after a key's events in order, and after what runs out by now; rows go to out."""
        killed, cleared, armed, until, generation = latch
        for at, number, event in [*log, (now, None, None)]:
            stands = killed != NEVER and cleared < killed
            if until != NEVER and until <= at:
                if not stands and armed > killed:
                    out.append((key, until, None, "observe", generation))
                until = NEVER
            if event is None:
                break
            if event == "kill":
                killed, generation = at, generation + 1
            elif event == "clear":
                cleared = at
            elif event == "arm":
                armed, until = at, at + self.ttl
            mode = "killed" if killed != NEVER and cleared < killed else "armed" if until != NEVER and armed > killed else "observe"
            out.append((key, at, number, mode, generation))
        return killed, cleared, armed, until, generation

    def close(self) -> None:
        pass


def _due(micros: int) -> int:
    """The first whole millisecond that is not before it."""
    return -(-micros // 1000)


def safety_modes(log: DataFrame, key: str, ttl_seconds: int, watermark: str, buckets: int = BUCKETS) -> DataFrame:
    """A stream of (key, at, event_id, event) -> the mode after every event, and where an arming runs out (event_id null).

    event: kill, clear, arm, others change nothing and MARK gives no row. Rules as in operators.state.safety_mode: killed while
    the last kill stands, else armed until the last arming runs out or a kill ends it, else observe; generation counts kills. at is in
    microseconds in the result. Rows come out when the watermark has passed them. The key is of a type that its text gives back. Needs a
    state store with column families: see streams.collected(store=ROCKS).
    """
    kind = log.schema[key].dataType.simpleString()
    marked = log.withColumn("clock", F.col("at").cast("timestamp")).withWatermark("clock", watermark)
    # no nulls but in texts: pandas would hand on the other numbers of the column as doubles
    rows = marked.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), "clock", F.unix_micros("clock").alias("at"),
        F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("event_id"), F.col("event_id").isNotNull().alias("numbered"), F.coalesce("event", F.lit("")).alias("event"),
    )
    out = "key string, at long, event_id long, mode string, generation long"
    found = rows.groupBy("bucket").transformWithStateInPandas(_Modes(ttl_seconds * 1_000_000), out, "Append", "EventTime")
    return found.select(F.col("key").cast(kind).alias(key), "at", "event_id", "mode", "generation")
