"""State from event logs: latest versions, claims, budgets, transitions, leases, sessions.

Tables are append-only. What a mutable store would update in place is the last event of a key here, and what it would
enforce by a constraint is a query that must return no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.machines import carried, moved
from tidemark.sources.bars import keep_last


def latest_versions(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last event of each key: one aggregation with partial maxima, no sort."""
    return keep_last(log, keys, order)


def new_only(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert if absent: the first of each key among incoming rows that stored doesn't have."""
    first = keep_last(incoming.withColumn("__rank", F.lit(0)), keys, ["__rank"]) if not order else _first(incoming, keys, order)
    return first.join(stored.select(*keys), list(keys), "left_anti")


def _first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def insert_outcomes(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """incoming with outcome: 'inserted', 'unchanged' (the key stands there with this body) or 'conflict'."""
    there = stored.select(*keys, F.col(body).alias("__body"), F.lit(True).alias("__there"))
    joined = incoming.join(there, list(keys), "left")
    outcome = F.when(F.col("__there").isNull(), "inserted").when(F.col(body).eqNullSafe(F.col("__body")), "unchanged").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("__body", "__there")


def conflicting_keys(log: DataFrame, keys: Sequence[str], body: Sequence[str]) -> DataFrame:
    """Keys that stand with more than one body: rows, distinct bodies."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*body)).alias("bodies")).filter("bodies > 1")


def replays(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """log with replayed: whether an earlier row has this key."""
    first = log.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    return log.join(first, list(keys)).withColumn("replayed", F.struct(*order) > F.col("__first")).drop("__first")


def daily_cap(entries: DataFrame, by: Sequence[str], at: str, order: Sequence[str], most: int) -> DataFrame:
    """entries with day, number within their day and accepted (number up to most)."""
    dated = entries.withColumn("day", F.to_date(at))
    w = Window.partitionBy(*by, "day").orderBy(*order)
    return dated.withColumn("number", F.row_number().over(w)).withColumn("accepted", F.col("number") <= most)


def within_budget(claims: DataFrame, by: Sequence[str], order: Sequence[str], amount: str, most: int, total: str) -> DataFrame:
    """claims with accepted, used_count, used_amount: each is accepted if count and amount then still fit, in order.

    A claim that does not fit leaves the budget as it is, so a later smaller one may fit. A task streams through a
    permit's claims with two numbers.
    """
    limit, exact = Decimal(total), f"__{amount}"

    def step(used: tuple[int, Decimal], values: tuple) -> tuple[tuple[int, Decimal], tuple]:
        n, so_far = used
        fits = values[0] is not None and n < most and so_far + values[0] <= limit
        used = (n + 1, so_far + values[0]) if fits else used
        return used, (fits, *used)

    added = StructType().add("accepted", "boolean").add("used_count", "integer").add("used_amount", "decimal(38,8)")
    rows = claims.withColumn(exact, F.col(amount).cast("decimal(38,8)"))
    return carried(rows, by, order, [exact], lambda: (0, Decimal(0)), step, added).drop(exact)


def transitions(log: DataFrame, by: Sequence[str], order: Sequence[str], status: str, allowed: Sequence[tuple[str | None, str]]) -> DataFrame:
    """Changes of status that are not allowed: by, order, previous, status. None is the state before the first event."""
    w = Window.partitionBy(*by).orderBy(*order)
    moved = log.withColumn("previous", F.lag(status).over(w)).filter(~F.col(status).eqNullSafe(F.col("previous")))
    legal = F.lit(False)
    for before, after in allowed:
        legal = legal | (F.col("previous").eqNullSafe(F.lit(before)) & (F.col(status) == after))
    return moved.filter(~legal)


def folded(log: DataFrame, by: Sequence[str], order: Sequence[str], event: str, start: str, moves: dict[tuple[str, str], str]) -> DataFrame:
    """State of each key after its events in order: moves[state, event] is the next state, any other event changes nothing."""
    seen = moved(log.select(*by, *order, F.col(event).alias("__e")), by, order, "__e", moves, start)
    return seen.groupBy(*by).agg(F.max_by("after", F.struct(*order)).alias("state"), F.count("*").alias("events"))


def sessions(beats: DataFrame, by: Sequence[str], at: str, gap_seconds: int) -> DataFrame:
    """Stretches of beats that are less than the gap apart: begin, last beat, end (the lease runs out), beats."""
    found = beats.groupBy(*by, F.session_window(at, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("beats"), F.max(at).alias("last_beat"))
    return found.select(*by, F.col("w.start").alias("begin"), "last_beat", F.col("w.end").alias("until"), "beats")


def lease_at(asked: DataFrame, leases: DataFrame, on: str | Sequence[str], asked_at: str, issued: str, expires: str, lease_id: str, applied_at: str | None = None) -> DataFrame:
    """As-of join: asked rows with the newest lease that agrees in all columns on, was issued by then and has not run out.

    asked needs a column row_id. With applied_at only leases that have one count. A newer lease that has run out does not
    hide an older live one. One shuffle, and no product of a key's rows: a task streams through a key in the order of time
    and holds the leases that no newer one outlasts.
    """
    on = [on] if isinstance(on, str) else list(on)
    valid = leases if applied_at is None else leases.filter(F.col(applied_at).isNotNull())
    at = lambda c: F.col(c).cast("timestamp_ntz")
    left = asked.select(*on, at(asked_at).alias("__at"), F.lit(1).alias("__kind"), F.col("row_id").alias("__row"), F.lit(None).cast(leases.schema[lease_id].dataType).alias("__lease"), F.lit(None).cast("timestamp_ntz").alias("__expires"))
    right = valid.select(*on, at(issued).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(asked.schema["row_id"].dataType).alias("__row"), F.col(lease_id).alias("__lease"), at(expires).alias("__expires"))

    def step(live: list[tuple], values: tuple) -> tuple[list[tuple], tuple]:
        kind, now, lease, until = values
        if kind == 0:
            while live and live[-1][0] <= until:
                live.pop()
            return [*live, (until, lease)] if until is not None else live, (None,)
        while live and live[-1][0] <= now:
            live.pop()
        return live, (live[-1][1] if live else None,)

    added = StructType().add("__held", leases.schema[lease_id].dataType)
    rows = left.unionByName(right)
    found = carried(rows, on, ["__at", "__kind", "__lease"], ["__kind", "__at", "__lease", "__expires"], list, step, added)
    return found.filter("__kind = 1").select(*on, F.col("__row").alias("row_id"), F.col("__at").alias(asked_at), F.col("__held").alias(lease_id))


def safety_mode(log: DataFrame, by: Sequence[str], as_of: str, ttl_seconds: int) -> DataFrame:
    """killed while the last kill event stands, else armed within the TTL of the last arming, else observe.

    log: by, at, event ('kill', 'clear' or 'arm'). A kill also ends an arming before it; generation counts kills.
    """
    at = F.col("at")
    last = lambda kind: F.max(F.when(F.col("event") == kind, at))
    found = log.filter(at <= F.lit(as_of).cast("timestamp_ntz")).groupBy(*by).agg(last("kill").alias("k"), last("clear").alias("c"), last("arm").alias("a"), F.count_if(F.col("event") == "kill").alias("generation"))
    killed = F.col("k").isNotNull() & (F.col("c").isNull() | (F.col("c") < F.col("k")))
    until = F.timestamp_add("SECOND", F.lit(ttl_seconds), "a")
    armed = (until > F.lit(as_of).cast("timestamp_ntz")) & (F.col("k").isNull() | (F.col("a") > F.col("k")))
    return found.select(*by, F.when(killed, "killed").when(F.coalesce(armed, F.lit(False)), "armed").otherwise("observe").alias("mode"), "generation")


def due_runs(runs: DataFrame, as_of: str, interval_hours: int = 24, retry_hours: int = 1, scopes: DataFrame | None = None) -> DataFrame:
    """Last run of each key with due: a day after the end of one that completed, an hour after any other one's end or else start.

    With scopes (one row a scope) also those without any run, which are due.
    """
    last = latest_versions(runs, ["scope"], ["started_at", "run_id"])
    hours = F.when(F.col("status") == "completed", interval_hours).otherwise(retry_hours)
    due = F.timestamp_add("HOUR", hours, F.coalesce("finished_at", "started_at")) <= F.lit(as_of).cast("timestamp_ntz")
    return (last if scopes is None else scopes.select("scope").join(last, "scope", "left")).withColumn("due", F.coalesce(due, F.lit(True)))


def preview_expired(column: str, as_of: str, ttl_seconds: int = 45) -> Column:
    return F.timestamp_add("SECOND", F.lit(ttl_seconds), F.col(column)) < F.lit(as_of).cast("timestamp_ntz")


def generation_conflicts(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Generations that more than one writer took; there must be none."""
    return log.groupBy(*by, "generation").count().filter("count > 1")


def identities(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    return log.select(*columns).distinct()


def single_identity(log: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """The one value that all rows of a key have, null where there are several."""
    return log.groupBy(*by).agg(F.min(column).alias("__a"), F.max(column).alias("__b")).select(*by, F.when(F.col("__a") == F.col("__b"), F.col("__a")).alias(column))


def matched_orders(pending: DataFrame, intents: DataFrame, key: str) -> DataFrame:
    """Full outer match with outcome: 'matched', 'order_without_intent' or 'intent_without_order'."""
    left = pending.select(key, F.lit(True).alias("__order"))
    right = intents.select(key, F.lit(True).alias("__intent"))
    outcome = F.when(F.col("__intent").isNull(), "order_without_intent").when(F.col("__order").isNull(), "intent_without_order").otherwise("matched")
    return left.join(right, key, "full_outer").select(key, outcome.alias("outcome"))


#: States of an intent after which a restart leaves its position as it is, and those that prove that nothing was sent.
SETTLED = ("accepted", "reconciled", "terminal_verified")
NOTHING_SENT = ("blocked_before_dispatch", "rejected")


def recovery(positions: DataFrame, intents: DataFrame, attempts: int = 5) -> DataFrame:
    """What becomes of unfinished positions after a restart, from the intent that each one waits for.

    positions: position_id, status, entry_intent_id, exit_intent_id, exit_attempts (the one under way counts); intents:
    intent_id, intent_status, commit_key. Only what proves that nothing was dispatched is undone by itself; all else asks
    for a person. An exit that was refused counts as an attempt, and the last one asks for a person; one that was never
    sent doesn't count.
    """
    wanted = F.when(F.col("status") == "entry_submitted", F.col("entry_intent_id")).otherwise(F.col("exit_intent_id"))
    joined = positions.withColumn("intent_id", wanted).join(intents, "intent_id", "left")
    waits, entry = F.col("status").isin("entry_submitted", "exit_submitted"), F.col("status") == "entry_submitted"
    known = F.col("intent_status").isNotNull()
    unsent, refused = waits & known & (F.coalesce("commit_key", F.lit("")) == ""), waits & known & F.col("intent_status").isin(*NOTHING_SENT)
    spent = F.col("exit_attempts") >= attempts
    outcome = (
        F.when(~waits, F.col("status"))
        .when(entry & (F.col("intent_id").isNull() | unsent | refused), "entry_unfilled")
        .when(unsent, "long")
        .when(refused, F.when(spent, "manual_review").otherwise("long"))
        .when(F.col("intent_status").isin(*SETTLED), F.col("status"))
        .otherwise("manual_review")
    )
    left = F.when(unsent & ~entry, F.greatest(F.col("exit_attempts") - 1, F.lit(0))).otherwise(F.col("exit_attempts"))
    return joined.withColumn("outcome", outcome).withColumn("exit_attempts", left)


def joined_latest(fresh: DataFrame, recovered: DataFrame, key: str, seen: str) -> DataFrame:
    """Union of two sources of the same rows; where both have a key, the recovered row counts."""
    both = fresh.withColumn(seen, F.lit(0)).unionByName(recovered.withColumn(seen, F.lit(1)))
    return keep_last(both, [key], [seen])


def allowed_status(column: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def clamp(limit: int, most: int = 200) -> int:
    return max(1, min(limit, most))


__all__ = [n for n in globals() if not n.startswith("_") and n not in ("Sequence", "Column", "DataFrame", "Window", "F", "V", "annotations")]
