"""Append-only tables with unique keys, written batch by batch, each batch exactly once.

A table is a folder: rows and conflicts by batch, and a ledger with one row for each batch that is complete. Only
batches of the ledger are read. A batch that fails before its ledger row is written leaves nothing behind that anyone reads, and writes the
same folders again when it is repeated; one that is in the ledger is passed over. So a stream with checkpoints gives
every row once, whatever fails. One writer at a time, as one stream is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.integrity import chained
from tidemark.sources.tables import shared_path, stored


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class AppendTable:
    """Rows of schema with unique keys; of a key's rows the first in order stands, and an unequal body is a conflict.

    A null is a key value and a body value like others. order must be unique within a key of a batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], body: Sequence[str], order: Sequence[str]):
        self.spark, self.path, self.schema, self.keys, self.body, self.order = spark, path.rstrip("/"), schema, list(keys), list(body), list(order)

    def _read(self, part: str, schema: StructType) -> DataFrame:
        whole = StructType([*schema.fields]).add("batch", "long")
        if not _exists(self.spark, f"{self.path}/{part}"):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.path}/{part}")

    def ledger(self) -> DataFrame:
        """batch, inserted, unchanged, conflicts of every complete batch."""
        return self._read("ledger", StructType().add("inserted", "long").add("unchanged", "long").add("conflicts", "long"))

    def rows(self) -> DataFrame:
        return self._read("rows", self.schema).join(self.ledger().select("batch"), "batch", "left_semi").select(*self.schema.names, "batch")

    def conflicts(self) -> DataFrame:
        """Rows that were refused, as they came."""
        return self._read("conflicts", self.schema).join(self.ledger().select("batch"), "batch", "left_semi").select(*self.schema.names, "batch")

    def judged(self, batch: DataFrame) -> DataFrame:
        """batch with outcome: inserted, unchanged or conflict. The stored table is read for the batch's keys, not shuffled where they are few."""
        names = {k: f"__k{i}" for i, k in enumerate(self.keys)}
        keyed = batch.withColumns({n: F.struct(F.col(k)) for k, n in names.items()})  # a struct is never null, so null keys join
        of = list(names.values())
        first = keyed.groupBy(*of).agg(F.min(F.struct(*self.order)).alias("__order"), F.min_by(F.struct(*self.body), F.struct(*self.order)).alias("__first"))
        old = self.rows().withColumns({n: F.struct(F.col(k)) for k, n in names.items()}).select(*of, F.struct(*self.body).alias("__old"), F.lit(True).alias("__there"))
        found = keyed.join(first, of).join(old.join(first.select(*of), of, "left_semi"), of, "left")
        new = F.col("__there").isNull() & (F.struct(*self.order).eqNullSafe(F.col("__order")))
        same = F.struct(*self.body).eqNullSafe(F.when(F.col("__there"), F.col("__old")).otherwise(F.col("__first")))
        return found.select(*batch.columns, F.when(new, "inserted").when(same, "unchanged").otherwise("conflict").alias("outcome"))

    def append(self, batch: DataFrame, number: int) -> None:
        """One batch; a number that the ledger has changes nothing."""
        if self.ledger().filter(F.col("batch") == number).limit(1).count():
            return
        found = stored(self.judged(batch.select(*self.schema.names)), "batch")
        self._write("rows", self.added(found.filter("outcome = 'inserted'").drop("outcome")), number)
        self._write("conflicts", found.filter("outcome = 'conflict'").drop("outcome"), number)
        counted = lambda kind: F.count_if(F.col("outcome") == kind)
        self._write("ledger", found.agg(counted("inserted").alias("inserted"), counted("unchanged").alias("unchanged"), counted("conflict").alias("conflicts")), number)

    def added(self, rows: DataFrame) -> DataFrame:
        return rows

    def _write(self, part: str, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}/batch={number}")

    def drain(self, stream: DataFrame, checkpoint: str | None = None, append: Callable[[DataFrame, int], None] | None = None) -> None:
        """Append what the stream has now. With the same checkpoint a later call goes on where this one ended or failed."""
        where = checkpoint or shared_path(self.spark, "append-state")
        stream.writeStream.option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(append or self.append).start().awaitTermination()


class AuditTable(AppendTable):
    """Events of hash chains: what a batch adds to a chain goes on from the chain's last row.

    schema: chain, order (a number that rises) and the fields of integrity. Rows behind the end of their chain are conflicts, as a chain
    can't be written into.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, chain: str, order: str):
        super().__init__(spark, path, schema, [chain, order], [c for c in schema.names if c not in (chain, order)], [order])
        self.chain, self.at = chain, order

    def _hashed(self) -> StructType:
        return StructType([*self.schema.fields]).add("previous_hash", "string").add("event_hash", "string")

    def chained_rows(self) -> DataFrame:
        """rows() with previous_hash and event_hash."""
        return self._read("rows", self._hashed()).join(self.ledger().select("batch"), "batch", "left_semi")

    def heads(self) -> DataFrame:
        """The last hash and order of every chain."""
        return self.chained_rows().groupBy(self.chain).agg(F.max_by("event_hash", self.at).alias("head"), F.max(self.at).alias("last"))

    def judged(self, batch: DataFrame) -> DataFrame:
        found = super().judged(batch).join(self.heads().drop("head"), self.chain, "left")
        late = (F.col("outcome") == "inserted") & (F.col(self.at) <= F.col("last"))
        return found.withColumn("outcome", F.when(late, "conflict").otherwise(F.col("outcome"))).drop("last")

    def added(self, rows: DataFrame) -> DataFrame:
        return chained(rows, self.chain, self.at, self.heads().drop("last"))
