"""Hash chains and seals. Building a chain is serial within the chain; checking one is not.

A chain is valid if every row's hash is that of its own content with the hash it names before it, and that one is the
hash of the row before. Each of the two is a test of a row and its neighbour, so a check is one window pass in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tidemark.functions import canonical
from tidemark.functions.documents import row_seal
from tidemark.operators.machines import carried

GENESIS = "0" * 64
FIELDS = ["utc_time", "actor", "event_type", "correlation_id", "payload_json"]


def entry_hash(previous: Column) -> Column:
    """Hash of an audit row: the previous hash and the row's texts, a bar between them; a missing correlation is empty."""
    return F.sha2(F.concat_ws("|", previous, *[F.coalesce(F.col(c), F.lit("")) for c in FIELDS]), 256)


def chained(events: DataFrame, chain: str, order: str, heads: DataFrame | None = None) -> DataFrame:
    """events with previous_hash and event_hash: a chain of its own for every value of `chain`, in order.

    heads (chain, head) are hashes that chains go on from. Each hash takes the one before it, so one task writes a chain, as one writer does; many
    chains are written side by side. A null chain needs a name first: heads don't find it.
    """
    kept = [chain, order, *FIELDS]
    known = events.select(*kept, F.lit(GENESIS).alias("head")) if heads is None else events.select(*kept).join(heads, chain, "left").select(*kept, F.coalesce("head", F.lit(GENESIS)).alias("head"))

    def step(last: str | None, values: tuple) -> tuple[str, tuple]:
        *texts, head = values
        before = head if last is None else last
        own = hashlib.sha256("|".join([before, *["" if t is None else t for t in texts]]).encode()).hexdigest()
        return own, (before, own)

    added = StructType().add("previous_hash", "string").add("event_hash", "string")
    return carried(known, [chain], [order], [*FIELDS, "head"], lambda: None, step, added).drop("head")


def _judged(rows: DataFrame, chain: str, order: str) -> DataFrame:
    """rows with broken: what is wrong with each, null if nothing is."""
    before = F.coalesce(F.lag("event_hash").over(Window.partitionBy(chain).orderBy(order)), F.lit(GENESIS))
    found = rows.withColumn("__before", before)
    wrong = F.when(~F.col("previous_hash").eqNullSafe(F.col("__before")), "previous_hash").when(~F.col("event_hash").eqNullSafe(entry_hash(F.col("previous_hash"))), "event_hash")
    return found.withColumn("broken", wrong).drop("__before")


def chain_breaks(rows: DataFrame, chain: str, order: str) -> DataFrame:
    """Rows where a chain does not hold, with what is wrong."""
    return _judged(rows, chain, order).filter("broken IS NOT NULL")


def verified(rows: DataFrame, chain: str, order: str) -> DataFrame:
    """One row a chain: events, valid, last hash. The rows are read once."""
    return _judged(rows, chain, order).groupBy(chain).agg(F.count("*").alias("events"), (F.count("broken") == 0).alias("valid"), F.max_by("event_hash", order).alias("last_hash"))


def _content(rows: DataFrame, name: str) -> Column:
    """Hash of all columns but name; a NaN is a missing number."""
    kept = [f for f in rows.schema.fields if f.name != name]
    plain = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in kept]
    return canonical.content_hash(F.struct(*plain), StructType(kept))


def sealed(rows: DataFrame, name: str = "row_hash") -> DataFrame:
    """rows with the hash of all their other columns."""
    return rows.drop(name).withColumn(name, _content(rows, name))


def seal_mismatches(rows: DataFrame, name: str = "row_hash") -> DataFrame:
    """Rows whose hash is not that of their content."""
    return rows.filter(~_content(rows, name).eqNullSafe(F.col(name)))


def binding_mismatches(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys of both with the names of the columns in which they differ, null-safely; only keys with any."""
    renamed = right.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in columns]))
    return left.join(renamed, key).select(key, names.alias("mismatches")).filter(F.size("mismatches") > 0)


def evidence_hash(columns: Sequence[str], left_out: Sequence[str] = ("generated_at",)) -> Column:
    """Hash of a row without the columns that change from reading to reading."""
    return row_seal(*[c for c in columns if c not in left_out])


def dataset_hash(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Order-free identity of a set of rows: their hashes, sorted within 256 buckets and hashed again, then all buckets.

    It tells sets apart as a hash over one long document would, and no task sees more than a bucket's hashes.
    """
    leaf = rows.select(F.sha2(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}), 256).alias("h"))
    node = leaf.groupBy(F.substring("h", 1, 2).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return node.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ""), 256).alias("dataset_sha256"))
