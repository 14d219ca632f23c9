"""Permits with a budget: register, revoke and claim events, every one with its outcome.

The budget is greedy: a claim that doesn't fit leaves it as it is, and a signal counts once over all permits. A permit of up to LONG events none of
whose signals another permit names depends on its own events alone: one fold over each such permit's events settles it. Others are settled together, and
what only looks at the permit (validity, body, revocation) is joins and minima there. Their budgets are settled in rounds over the claims that are
still open. A claim above what is left can never fit again, as budgets only shrink; running sums over the others say how far a permit can be
settled at once: up to the first that overflows or whose signal another open claim has before it. Every round settles
at least the earliest claim of the log, mostly far more, and later rounds see only what is still open. Sums run by ranges of a permit's
claims, so one permit may hold most of the log.
"""

from __future__ import annotations

from decimal import Context, Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.machines import carried
from tidemark.operators.scans import running
from tidemark.sources.tables import stored

AMOUNT = "decimal(38,8)"
#: Events of a permit up to which one task folds them; its signals are held meanwhile.
LONG = 10_000
#: Rounds after which what they settled is put into one table.
ROUNDS = 20
_EXACT = Context(prec=76)


def outcomes(log: DataFrame, long: int = LONG) -> DataFrame:
    """log with outcome, used_orders and used_total of its permit after the event.

    log: seq (unique), permit_id, at, kind, body (identity of the permit's terms), issued_at, expires_at, max_orders,
    max_total, signal, notional. A permit exists from its first register, or claim that is valid and within its own terms. Outcomes of
    register: registered, unchanged, body_mismatch; of revoke: revoked, unchanged, permit_missing; of claim: claimed, not_valid,
    body_mismatch, revoked, orders_exhausted, total_exhausted, already_claimed, in this order of precedence. Other kinds and
    claims without signal or notional are invalid.
    """
    base = log.withColumn("__amount", F.col("notional").cast(AMOUNT)).withColumn("__most", F.col("max_total").cast(AMOUNT))
    kind, sound = F.col("kind"), F.col("signal").isNotNull() & F.col("__amount").isNotNull() & (F.col("__amount") >= 0)
    valid = F.coalesce((F.col("at") >= F.col("issued_at")) & (F.col("at") < F.col("expires_at")), F.lit(False))
    makes = (kind == "register") | ((kind == "claim") & sound & valid & (F.col("max_orders") > 0) & (F.col("__amount") <= F.col("__most")))
    facts = {"__sound": F.coalesce((kind == "claim") & sound, F.lit(False)), "__valid": valid, "__makes": F.coalesce(makes, F.lit(False))}
    known = stored(base.filter("permit_id IS NOT NULL").withColumns(facts), "permits")
    tied = _tied(known, long)
    if tied.limit(1).count():
        out = _folded(known.join(tied, "permit_id", "left_anti")).select(*log.columns, *_ADDED)
        return out.unionByName(_together(known.join(tied, "permit_id", "left_semi")).select(*log.columns, *_ADDED))
    return _folded(known).select(*log.columns, *_ADDED)


_ADDED = ["outcome", "used_orders", "used_total"]


def _tied(known: DataFrame, long: int) -> DataFrame:
    """(permit_id) of permits that name a signal which another names too, or with more than long events."""
    claims = known.filter("kind = 'claim' AND signal IS NOT NULL").select("permit_id", "signal")
    shared = stored(claims.groupBy("signal").agg(F.min("permit_id").alias("a"), F.max("permit_id").alias("b")).filter("a != b").select("signal"), "shared")
    tied = known.groupBy("permit_id").count().filter(F.col("count") > long).select("permit_id")
    if shared.limit(1).count():
        tied = tied.unionByName(claims.join(shared, "signal", "left_semi").select("permit_id"))
    return stored(tied.distinct(), "tied")


def _folded(known: DataFrame) -> DataFrame:
    """Outcomes of permits that depend on their own events alone."""
    def step(state: tuple, values: tuple) -> tuple[tuple, tuple]:
        kind, body, sound, valid, makes, signal, amount, orders, most = values
        there, made, ended, n, total, signals = state
        if makes and not there:
            first, there, made = True, True, body
        else:
            first = False
        if kind == "register":
            outcome = "registered" if first else "unchanged" if body == made else "body_mismatch"
        elif kind == "revoke":
            outcome = "permit_missing" if not there else "unchanged" if ended else "revoked"
            ended = ended or there
        elif not sound:
            outcome = "invalid"
        elif not valid:
            outcome = "not_valid"
        elif there and body != made:
            outcome = "body_mismatch"
        elif ended:
            outcome = "revoked"
        elif orders is not None and n >= orders:
            outcome = "orders_exhausted"
        elif most is not None and _EXACT.add(total, amount) > most:
            outcome = "total_exhausted"
        elif signal in signals:
            outcome = "already_claimed"
        elif orders is None or most is None:
            outcome = None
        else:
            outcome, n, total = "claimed", n + 1, _EXACT.add(total, amount)
            signals.add(signal)
        return (there, made, ended, n, total, signals), (outcome, n, total)

    columns = ["kind", "body", "__sound", "__valid", "__makes", "signal", "__amount", "max_orders", "__most"]
    added = StructType().add("outcome", "string").add("used_orders", "long").add("used_total", AMOUNT)
    return carried(known, ["permit_id"], ["seq"], columns, lambda: (False, None, False, 0, Decimal(0), set()), step, added)


def _together(rows: DataFrame) -> DataFrame:
    """Outcomes of permits that share signals or are long."""
    kind = F.col("kind")
    made = rows.groupBy("permit_id").agg(F.min(F.when(F.col("__makes"), F.struct("seq", "body"))).alias("__made"))
    known = stored(rows.join(made, "permit_id").withColumn("__there", F.coalesce(F.col("seq") >= F.col("__made.seq"), F.lit(False))), "permits")
    ended = known.filter("kind = 'revoke' AND __there").groupBy("permit_id").agg(F.min("seq").alias("__ended"))
    dated = known.join(ended, "permit_id", "left")
    same = F.col("body").eqNullSafe(F.col("__made.body"))
    gone = F.coalesce(F.col("seq") > F.col("__ended"), F.lit(False))
    at_once = (
        F.when(kind == "register", F.when(F.col("seq") == F.col("__made.seq"), "registered").when(same, "unchanged").otherwise("body_mismatch"))
        .when(kind == "revoke", F.when(~F.col("__there"), "permit_missing").when(F.col("seq") == F.col("__ended"), "revoked").otherwise("unchanged"))
        .when(F.col("__sound"), F.when(~F.col("__valid"), "not_valid").when(F.col("__there") & ~same, "body_mismatch").when(F.col("__there") & gone, "revoked"))
        .otherwise("invalid")
    )
    judged = stored(dated.withColumn("__first", at_once), "judged")
    claims = judged.filter("__first IS NULL").select("seq", "permit_id", "signal", "__amount", "max_orders", "__most")
    used = judged.join(_settled(claims), "seq", "left").withColumn("outcome", F.coalesce("outcome", "__first"))
    taken = F.col("outcome") == "claimed"
    out = running(used, ["permit_id"], ["seq"], sums={"used_orders": F.when(taken, 1).otherwise(0), "used_total": F.when(taken, F.col("__amount")).otherwise(F.lit(0).cast(AMOUNT))}, inclusive=True)
    return out.withColumn("used_total", F.col("used_total").cast(AMOUNT))


def _settled(claims: DataFrame) -> DataFrame:
    """(seq, outcome) of claims that only the budget and earlier claims of their signal can refuse."""
    zero = F.lit(0).cast(AMOUNT)
    rows = claims.withColumns({"__claimed": F.lit(False), "__orders": F.col("max_orders").cast("long"), "__left": F.col("__most")}).drop("max_orders", "__most")
    open_, found = stored(rows, "open"), []
    while open_.limit(1).count():
        fit = open_.withColumn("__fits", ~F.col("__claimed") & (F.col("__orders") > 0) & (F.col("__amount") <= F.col("__left")))
        first = fit.filter("__fits").groupBy("signal").agg(F.min("seq").alias("__first"))
        marked = fit.join(first, "signal", "left").withColumn("__waits", F.col("__fits") & (F.col("seq") > F.col("__first"))).drop("__first")
        # what waits, or stands behind one that waits, is not settled now, so it may count in the sums
        summed = running(marked, ["permit_id"], ["seq"], sums={"__before_n": F.col("__fits").cast("long"), "__before": F.when(F.col("__fits"), F.col("__amount")).otherwise(zero)})
        full = F.when(F.col("__before_n") >= F.col("__orders"), "orders_exhausted").when(F.col("__before").cast(AMOUNT) + F.col("__amount") > F.col("__left"), "total_exhausted")
        named = summed.withColumn("outcome", full)
        stops = named.filter("__fits AND (__waits OR outcome IS NOT NULL)").groupBy("permit_id").agg(F.min("seq").alias("__stop"))
        stopped = named.join(stops, "permit_id", "left").withColumn("__now", F.col("__stop").isNull() | (F.col("seq") < F.col("__stop")) | ((F.col("seq") == F.col("__stop")) & ~F.col("__waits")))
        reason = F.coalesce("outcome", F.when(F.col("__claimed"), "already_claimed").when(F.col("__fits"), "claimed"))
        done = stored(stopped.withColumn("outcome", reason), "settled")
        now = done.filter("__now")
        found.append(now.select("seq", "outcome"))
        if len(found) > ROUNDS:
            found = [stored(reduce(DataFrame.unionByName, found), "outcomes")]
        # what this round took leaves less to the claims that are still open
        taken = now.filter("outcome = 'claimed'")
        spent = taken.groupBy("permit_id").agg(F.count("*").alias("__n"), F.sum("__amount").cast(AMOUNT).alias("__sum"))
        left = done.filter("NOT __now").select(*rows.columns).join(spent, "permit_id", "left").join(taken.select("signal", F.lit(True).alias("__taken")), "signal", "left")
        less = {"__claimed": F.col("__claimed") | F.coalesce("__taken", F.lit(False)), "__orders": F.col("__orders") - F.coalesce("__n", F.lit(0)), "__left": (F.col("__left") - F.coalesce("__sum", zero)).cast(AMOUNT)}
        open_ = stored(left.withColumns(less).select(*rows.columns), "open")
    return reduce(DataFrame.unionByName, found) if found else claims.select("seq", F.lit(None).cast("string").alias("outcome"))
