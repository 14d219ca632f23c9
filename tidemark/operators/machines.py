"""State machines as tables of moves, and folds that stream over sorted keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Moves = dict[tuple[str | None, str], str]

#: States, and the events that lead from one to the next; None is the state before the first event.
POSITION: Moves = {
    (None, "open"): "entry_submitted", ("entry_submitted", "entry_filled"): "long", ("entry_submitted", "entry_none"): "entry_unfilled",
    ("long", "exit"): "exit_submitted", ("exit_submitted", "exit_abandoned"): "long", ("exit_submitted", "exit_part"): "long",
    ("exit_submitted", "exit_all"): "closed", ("exit_submitted", "attempts_spent"): "manual_review",
    ("entry_submitted", "review"): "manual_review", ("long", "review"): "manual_review", ("exit_submitted", "review"): "manual_review",
}
INTENT: Moves = {
    (None, "allowed"): "previewed", (None, "refused"): "rejected", ("previewed", "expired"): "expired", ("previewed", "refused"): "rejected",
    ("previewed", "claimed"): "dispatching", ("dispatching", "accepted"): "accepted", ("dispatching", "blocked"): "blocked_before_dispatch",
    ("dispatching", "credentials"): "credential_mismatch", ("dispatching", "refused"): "rejected", ("dispatching", "transport"): "transport_error",
    ("dispatching", "unclear"): "uncertain", ("dispatching", "found"): "reconciled", ("uncertain", "found"): "reconciled",
    ("dispatching", "restart"): "manual_review", ("uncertain", "restart"): "manual_review", ("manual_review", "reviewed"): "review_closed",
    ("accepted", "ended"): "terminal_verified", ("reconciled", "ended"): "terminal_verified", ("dispatching", "ended"): "terminal_verified",
    ("uncertain", "ended"): "terminal_verified", ("manual_review", "ended"): "terminal_verified",
}
EXECUTION: Moves = {
    (None, "claim"): "claimed", ("claimed", "preview"): "previewed", ("claimed", "refused"): "preview_rejected", ("previewed", "commit"): "commit_requested",
    ("commit_requested", "final"): "completed", ("commit_requested", "unclear"): "manual_review",
}
TRAINING: Moves = {(None, "start"): "running", ("running", "done"): "completed", ("running", "error"): "failed", ("running", "restart"): "failed"}
#: States of a position that is not at its end.
ACTIVE_POSITION = ("entry_submitted", "long", "exit_submitted", "manual_review")
#: States of an order that may still lead to a fill.
POTENTIAL_INTENT = ("dispatching", "uncertain", "manual_review", "accepted", "reconciled")


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], added: StructType) -> DataFrame:
    """rows with columns that a fold over each key's rows in order gives: step(state, values of columns) -> (state, values added).

    One shuffle by key and a sort; a task streams through its keys and holds one state and one batch, however many rows a
    key has.
    """
    # by the keys' hash, not the keys: Spark drops a repartition by what a join below deals by, and may then read that join's rows as they lie
    dealt = rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order)
    names, keyed = rows.columns, list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, last, state = to_arrow_schema(added), object(), None
        for batch in batches:
            out = []
            for key, values in zip(zip(*[batch.column(c).to_pylist() for c in keyed], strict=True), zip(*[batch.column(c).to_pylist() for c in columns], strict=True), strict=True):
                if key != last:
                    last, state = key, start()
                state, new = step(state, values)
                out.append(new)
            found = [pa.array([x[k] for x in out], f.type) for k, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*names, *arrow.names])

    return dealt.mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))


def moved(log: DataFrame, by: Sequence[str], order: Sequence[str], event: str, moves: Moves, start: str | None = None) -> DataFrame:
    """log with before, after and legal: the state around each event; an event that the table doesn't have changes nothing."""
    def step(state: str | None, values: tuple) -> tuple[str | None, tuple]:
        after = moves.get((state, values[0]))
        return (state, (state, state, False)) if after is None else (after, (state, after, True))

    return carried(log, by, order, [event], lambda: start, step, StructType().add("before", "string").add("after", "string").add("legal", "boolean"))


def several_potential(intents: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accounts of orders that may still lead to a fill, with their orders; more than one account is a conflict."""
    return intents.filter(F.col("status").isin(*POTENTIAL_INTENT)).groupBy(*by).agg(F.count("*").alias("orders"))


__all__ = ["ACTIVE_POSITION", "EXECUTION", "INTENT", "POSITION", "POTENTIAL_INTENT", "TRAINING", "Moves", "carried", "moved", "several_potential"]
