"""Compare-and-set over logs: which writers win, whatever share of the log one key has.

An attempt names the value that it expects and the one that it sets; it wins if the expected value is the current one. The
next winner after a winner is the first later attempt that expects what the winner set. That pointer is known for every attempt,
winner or not, from one scan; the winners are the attempts that the first one leads to, and doubling the pointers
finds them in as many rounds as the longest chain has binary digits. No task walks a key's log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import running
from tidemark.sources.tables import stored


def _reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of starts and of all that they lead to; edges: a, b, at most one for each a."""
    found, jump = stored(starts, "reached"), edges
    while True:
        more = found.join(jump, found["id"] == jump["a"]).select(F.col("b").alias("id"))
        wider = stored(found.unionByName(more).distinct(), "reached")
        if wider.count() == found.count():
            return wider
        far = jump.select(F.col("a").alias("b"), F.col("b").alias("__to"))
        jump = stored(jump.join(far, "b").select("a", F.col("__to").alias("b")), "jumps")
        found = wider


def compare_and_set(log: DataFrame, by: Sequence[str], order: str, expected: str, new: str, initial: Column) -> DataFrame:
    """log with before (the key's value when the attempt came) and won.

    order is unique within a key; initial is the value of a key without winners. An attempt whose expected or new value is null
    never wins. An attempt may set what it expects.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    base = stored(log.withColumn("__id", F.monotonically_increasing_id()), "attempts")
    named = base.select("__id", *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(order).alias("__order"), F.col(expected).alias("__expected"), F.col(new).alias("__new"))
    live = named.filter(F.col("__expected").isNotNull() & F.col("__new").isNotNull())
    point = lambda rows, token, kind, at: rows.select(*keys, F.col(token).alias("__token"), at.alias("__order"), F.lit(kind).alias("__kind"), "__id")
    asks, sets = point(live, "__expected", 1, F.col("__order")), point(live, "__new", 2, F.col("__order"))
    first = live.select(*keys).distinct().select(*keys, initial.cast(live.schema["__new"].dataType).alias("__token"), F.lit(None).cast(live.schema["__order"].dataType).alias("__order"), F.lit(0).alias("__kind"), F.lit(-1).cast("long").alias("__id"))
    # a null order comes first; of one attempt's two points the one that asks comes first, so an attempt never follows itself
    both = asks.unionByName(sets).unionByName(first)
    found = running(both, [*keys, "__token"], ["__order", "__kind"], lasts={"__next": F.when(F.col("__kind") == 1, F.col("__id"))}, after=True)
    known = found.filter(F.col("__next").isNotNull() & (F.col("__kind") != 1))
    starts = known.filter("__id = -1").select(F.col("__next").alias("id"))
    edges = known.filter("__id != -1").select(F.col("__id").alias("a"), F.col("__next").alias("b"))
    # only what something leads to can be reached
    led = edges.select(F.col("b").alias("a")).union(starts.select(F.col("id").alias("a"))).distinct()
    winners = _reached(starts, stored(edges.join(led, "a", "left_semi"), "edges"))
    marked = base.join(winners.select(F.col("id").alias("__id"), F.lit(True).alias("__won")), "__id", "left").withColumn("won", F.coalesce("__won", F.lit(False))).drop("__won", "__id")
    current = running(marked, by, [order], lasts={"before": F.when(F.col("won"), F.col(new))})
    return current.withColumn("before", F.coalesce("before", initial.cast(current.schema["before"].dataType)))


def kill_latch(log: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """log (event 'engage' or 'clear', expected_generation, credential, account) with generation, applied, active, bound_credential and
    bound_account, all as they are after the event.

    An engage always applies, counts the generation up and binds the identity if both of its parts are there. A clear
    applies only if the generation is still the expected one; it unbinds. Other events change nothing.
    """
    engage, clear = F.col("event") == "engage", F.col("event") == "clear"
    counted = running(log, by, [order], sums={"generation": F.when(engage, 1).otherwise(0)}, inclusive=True)
    applied = counted.withColumn("applied", F.coalesce(engage | (clear & (F.col("generation") == F.col("expected_generation"))), F.lit(False)))
    whole = F.col("credential").isNotNull() & (F.col("credential") != "") & F.col("account").isNotNull() & (F.col("account") != "")
    bound = F.when(F.col("applied") & clear, F.struct(F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("a"))).when(engage & whole, F.struct(F.col("credential").cast("string").alias("c"), F.col("account").cast("string").alias("a")))
    out = running(applied, by, [order], lasts={"__active": F.when(F.col("applied"), engage), "__bound": bound}, inclusive=True)
    return out.withColumn("active", F.coalesce("__active", F.lit(False))).withColumn("bound_credential", F.col("__bound.c")).withColumn("bound_account", F.col("__bound.a")).drop("__active", "__bound")


def cleared_reviews(latch: DataFrame, reviews: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """reviews (by, order: intents in manual review and when they came there) with closed_at: the first clear after them that applied."""
    ends = latch.filter("event = 'clear' AND applied").select(*by, order, F.lit(0).alias("__kind"), F.col(order).alias("__end"), F.lit(None).cast("long").alias("__row"))
    base = stored(reviews.withColumn("__row", F.monotonically_increasing_id()), "reviews")
    asks = base.select(*by, order, F.lit(1).alias("__kind"), F.lit(None).cast(reviews.schema[order].dataType).alias("__end"), "__row")
    found = running(ends.unionByName(asks), by, [order, "__kind", "__row"], lasts={"closed_at": F.col("__end")}, after=True).filter("__kind = 1")
    return base.join(found.select("__row", "closed_at"), "__row").drop("__row")
