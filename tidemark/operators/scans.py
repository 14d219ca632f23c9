"""Running values over long keys: a key's rows are spread over tasks, and only one row a task and key is put in one order.

A window over a key puts all of its rows into one task. Here rows are dealt by ranges of key and order, each range is
scanned by itself, and what the ranges of a key sum up to is carried from range to range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import stored


def ranged(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows as a table with __part, the range of key and order that each lies in, and __at, which rises with key and order."""
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    return stored(dealt, "running").withColumn("__part", F.shiftright("__at", 33))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, after: bool = False, inclusive: bool = False) -> DataFrame:
    """rows with sums of, and last values that are not null among, the rows of their key before them; or after them.

    order must be unique within a key. With after, rows that follow count, and a last value is that of the nearest one. With
    inclusive a row's own value counts too. A sum of nothing is 0 of the value's type, a last of nothing null. A null key is
    a key. The result is a table: the rows are written to the shared folder once.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    values = {f"__s_{n}": c for n, c in sums.items()} | {f"__l_{n}": c for n, c in lasts.items()}
    placed = ranged(rows.withColumns(values), by, order)
    way = (lambda c: F.desc(c)) if after else (lambda c: F.asc(c))
    inside = Window.partitionBy(*by, "__part").orderBy(way("__at")).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    nearest = F.min_by if after else F.max_by
    present = lambda c: F.when(F.col(c).isNotNull(), F.col("__at"))
    totals = placed.groupBy(*by, "__part").agg(F.count("*").alias("__rows"), *[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums], *[nearest(f"__l_{n}", present(f"__l_{n}")).alias(f"__l_{n}") for n in lasts])
    earlier = Window.partitionBy(*by).orderBy(way("__part")).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    keys = [F.struct(F.col(k)).alias(f"__key{i}") for i, k in enumerate(by)]  # a struct is never null: null keys join too
    starts = totals.select(*keys, "__part", *[F.sum(f"__s_{n}").over(earlier).alias(f"__c_{n}") for n in sums], *[last(f"__l_{n}", earlier).alias(f"__d_{n}") for n in lasts])
    own = {n: F.sum(f"__s_{n}").over(inside) for n in sums} | {n: last(f"__l_{n}", inside) for n in lasts}
    scanned = placed.select("*", *keys, *[c.alias(f"__o_{n}") for n, c in own.items()])
    zero = lambda n: F.lit(0).cast(scanned.schema[f"__o_{n}"].dataType)
    joined = scanned.join(starts, [*[f"__key{i}" for i in range(len(by))], "__part"])
    out = [(F.coalesce(f"__c_{n}", zero(n)) + F.coalesce(f"__o_{n}", zero(n))).alias(n) for n in sums]
    out += [F.coalesce(f"__o_{n}", f"__d_{n}").alias(n) for n in lasts]
    return joined.select(*rows.columns, *out)


def compounded(rows: DataFrame, by: Sequence[str], order: Sequence[str], factor: Column) -> DataFrame:
    """rows with equity, the product of factor (never negative) up to and with each row of its key, and peak, the largest
    equity so far, 1 at least.

    What a range passes on is the product of all of its factors and the largest product of its first few.
    """
    placed = ranged(rows.withColumn("__factor", factor), by, order)
    inside = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("__run", F.product("__factor").over(inside))
    own = own.withColumn("__top", F.max("__run").over(inside))
    totals = own.groupBy(*by, "__part").agg(F.max_by("__run", "__at").alias("__whole"), F.max("__top").alias("__most"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("__start", F.coalesce(F.product("__whole").over(earlier), F.lit(1.0)))
    starts = starts.withColumn("__held", F.coalesce(F.max(F.col("__start") * F.col("__most")).over(earlier), F.lit(1.0)))
    keys = [F.struct(F.col(k)).alias(f"__key{i}") for i, k in enumerate(by)]
    joined = own.select("*", *keys).join(starts.select(*keys, "__part", "__start", "__held"), [*[f"__key{i}" for i in range(len(by))], "__part"])
    return joined.select(*rows.columns, (F.col("__start") * F.col("__run")).alias("equity"), F.greatest(F.lit(1.0), "__held", F.col("__start") * F.col("__top")).alias("peak"))
