"""Late rows beside the others: a table in two parts, and the bars that late rows open again.

What is late is decided by complete earlier batches alone: behind the newest time in them less the delay. So a batch
that is repeated after a failure is judged as it was the first time. Rows of one batch are never late for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.tables import stored
from tidemark.streaming.sinks import AppendTable


class LateTable(AppendTable):
    """Rows of schema by batch, each once in on_time() or late(); at is a timestamp, and rows without one are late."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, at: str, delay_seconds: int):
        super().__init__(spark, path, schema, [], [], [at])
        self.at, self.delay = at, delay_seconds

    def ledger(self) -> DataFrame:
        """batch, newest (the newest time up to and with it), on_time, late of every complete batch."""
        return self._read("ledger", StructType().add("newest", "timestamp_ntz").add("on_time", "long").add("late", "long"))

    def on_time(self) -> DataFrame:
        return self.rows()

    def late(self) -> DataFrame:
        return self._read("late", self.schema).join(self.ledger().select("batch"), "batch", "left_semi").select(*self.schema.names, "batch")

    def append(self, batch: DataFrame, number: int) -> None:
        """One batch; a number that the ledger has changes nothing. Batches come in the order of their numbers."""
        known = self.ledger().agg(F.max("newest").alias("newest"), F.coalesce(F.bool_or(F.col("batch") == number), F.lit(False)).alias("done")).first()
        if known.done:
            return
        at = F.col(self.at).cast("timestamp_ntz")
        edge = F.timestamp_add("SECOND", F.lit(-self.delay), F.lit(known.newest).cast("timestamp_ntz"))
        late = at.isNull() | F.coalesce(at < edge, F.lit(False))
        found = stored(batch.select(*self.schema.names, late.alias("__late")), "late-batch")
        self._write("rows", found.filter("NOT __late").drop("__late"), number)
        self._write("late", found.filter("__late").drop("__late"), number)
        newest = F.greatest(F.max(at), F.lit(known.newest).cast("timestamp_ntz")).alias("newest")
        self._write("ledger", found.agg(newest, F.count_if(~F.col("__late")).alias("on_time"), F.count_if("__late").alias("late")), number)


def reopened(on_time: DataFrame, late: DataFrame, bar: Column, what: dict[str, Column]) -> DataFrame:
    """Bars that late rows change: each aggregate of what as first closed (null where the bar had no rows) and over all rows.

    Only rows of such bars are aggregated again; late rows without a time belong to no bar.
    """
    there = late.withColumn("bar", bar).filter("bar IS NOT NULL")
    first = on_time.withColumn("bar", bar).join(there.select("bar").distinct(), "bar", "left_semi")
    both = first.withColumn("__late", F.lit(False)).unionByName(there.select("*", F.lit(True).alias("__late")), allowMissingColumns=True)
    before = first.groupBy("bar").agg(*[c.alias(f"first_{n}") for n, c in what.items()])
    after = both.groupBy("bar").agg(*[c.alias(n) for n, c in what.items()], F.count_if("__late").alias("late_rows"))
    return after.join(before, "bar", "left")
