"""Exact de-duplication through an extendible-hash index on shared files.

Tasks over documents normalise texts, combine equal ones in a bounded buffer and write one entry for each (64-bit hash, compressed
text) to the shared folder. The directory of the index maps leading hash bits to buckets: it starts as one bucket, and as
long as a bucket holds more than CAPACITY bytes of unlike hashes the directory doubles and that bucket splits by one more
bit. Each owner task takes a range of buckets, so of keys, in hash order. Entries of one hash are chained and compared
byte by byte, so texts of equal hash but other bytes get links of their own; an owner holds the chain of one hash at a
time, however many entries it has. The links, one row an entry, are the index's last table. What is kept follows by aggregation over links.

A text that a third of all rows share is one entry a buffer, so no task sees its rows together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidemark.llm import common
from tidemark.llm.spans import binary_list

#: Compressed bytes of a bucket above which it splits.
CAPACITY = 4 << 20
#: Leading bits that the directory may use: at most a million slots. Beyond it buckets grow; owners stream them all the same.
DEPTH = 20
#: Bytes of unlike texts that a task over documents holds while it combines equal ones.
BUFFER = 32 << 20
_BLANK = b" \t\n\x0b\x0c\r"


def _hash(text: bytes, bits: int) -> int:
    """The first bits of a 64-bit hash, as a signed long."""
    h = xxhash.xxh64_intdigest(text) >> (64 - bits) << (64 - bits)
    return h - (1 << 64) if h >= 1 << 63 else h


def entries_of(docs: DataFrame, keep: list[str], text: str, bits: int, buffer: int) -> DataFrame:
    """The kept columns with row, points, text_sha256, entry, h and, where entry = row, the compressed text body."""
    names = [f"kept_{k}" for k in range(len(keep))]
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    added = [StructField(n, t) for n, t in (("row", LongType()), ("points", LongType()), ("text_sha256", StringType()), ("entry", LongType()), ("h", LongType()), ("body", BinaryType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int, str]] = {}
        held, pack = 0, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out: list[tuple[int, int, str, bytes | None]] = []
            for row, raw in zip(batch.column("row").to_pylist(), binary_list(batch.column("text")), strict=True):
                plain = raw.translate(None, _BLANK)
                body = None
                if (found := known.get(plain)) is None:
                    if held > buffer:
                        known, held = {}, 0
                    body = pack(plain)
                    found = known[plain] = (row, _hash(plain, bits), hashlib.sha256(plain).hexdigest())
                    held += len(plain) + 200
                out.append((*found, body))
            entry, h, digest, bodies = zip(*out, strict=True) if out else ((), (), (), ())
            points = pc.fill_null(pc.utf8_length(batch.column("text")), 0)
            arrays = [batch.column("row"), points.cast(pa.int64()), pa.array(digest, pa.string()), pa.array(entry, pa.int64()), pa.array(h, pa.int64()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *arrays], [*names, *[f.name for f in added]])

    return base.mapInArrow(run, StructType([*[base.schema[n] for n in names], *added]))


def directory(entries: DataFrame, capacity: int, depth: int = DEPTH) -> tuple[DataFrame, int, int]:
    """(slot, bucket) for every slot of the directory, its depth in bits and the number of buckets.

    Bytes are summed once for each cell of depth bits, at most a million; doubling and splitting work on these sums. Each
    cell counts in its prefix of every length, one row each. Cells lie in tasks by ranges, so that a task adds up most prefixes itself.
    A prefix is a bucket if it is not full and all shorter ones are; as sums only grow with shorter prefixes, the next shorter one tells.
    """
    cell = F.shiftrightunsigned("h", 64 - depth)
    cells = common.stored(entries.groupBy(cell.alias("cell")).agg(F.sum(F.length("body")).alias("size"), F.min("h").alias("low"), F.max("h").alias("high")), "cells")
    lengths = cells.repartitionByRange("cell").withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    sums = lengths.groupBy("bits", F.expr(f"shiftright(cell, {depth} - bits)").alias("prefix")).agg(F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))
    full = (F.col("size") > capacity) & (F.col("low") != F.col("high")) & (F.col("bits") < depth)
    sums = common.stored(sums.select("bits", "prefix", full.alias("full")), "splits")
    # a full prefix opens both of its halves; a half that no entry fell into has no bucket, nothing looks it up
    halves = sums.filter("full").select((F.col("bits") + 1).alias("bits"), F.explode(F.expr("array(2 * prefix, 2 * prefix + 1)")).alias("prefix"))
    opened = halves.unionByName(cells.sparkSession.range(1).select(F.lit(0).alias("bits"), F.lit(0).cast("long").alias("prefix")))
    made = common.stored(sums.filter("NOT full").join(opened, ["bits", "prefix"], "left_semi").select("prefix", "bits"), "buckets")
    now, n_buckets = made.agg(F.coalesce(F.max("bits"), F.lit(0)), F.count("*")).first()
    buckets = made.select(F.expr(f"shiftleft(prefix, {now} - bits)").alias("first"), "bits")
    # at most a million rows of two numbers in all; the number of a bucket is its place by key
    dealt = buckets.repartitionByRange("first").sortWithinPartitions("first").withColumn("at", F.monotonically_increasing_id())
    slots = dealt.select(F.explode(F.expr(f"sequence(first, first + shiftleft(1L, {now} - bits) - 1)")).alias("slot"), F.col("first").alias("bucket"))
    return slots, now, n_buckets


def chained(entries: DataFrame, slots: DataFrame, bits: int, owners: int) -> DataFrame:
    """(entry, h, link): entries of equal hash and equal bytes get the same link."""
    slot = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    found = entries.withColumn("slot", slot).join(F.broadcast(slots), "slot")
    # buckets are numbered by the first slot they hold: an owner's buckets are one range of keys
    owner = F.expr(f"cast(bucket * {owners} div {1 << bits} AS int)")
    dealt = found.select("entry", "h", "body", owner.alias("owner")).repartitionById(owners, F.col("owner")).sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        now, chain = None, []
        for batch in batches:
            links = []
            for h, body in zip(batch.column("h").to_pylist(), binary_list(batch.column("body")), strict=True):
                if h != now:
                    now, chain = h, []
                link = next((k for k, other in enumerate(chain) if other == body or unpack(other) == unpack(body)), len(chain))
                if link == len(chain):
                    chain.append(body)
                links.append(link)
            yield pa.RecordBatch.from_arrays([batch.column("entry"), batch.column("h"), pa.array(links, pa.int32())], ["entry", "h", "link"])

    return dealt.drop("owner").mapInArrow(run, "entry long, h long, link int")


def groups(docs: DataFrame, keep: list[str] | None = None, text: str = "text", bits: int = 64, capacity: int = CAPACITY, buffer: int = BUFFER) -> DataFrame:
    """The kept columns (doc_id unless named) of every row with keep_id, group_size, kept and text_sha256.

    docs needs doc_id and a text column; columns named like the added ones are replaced. Null counts as empty; empty and
    blank texts are one group. The row with the most code points in its original text stays, of ties that of the smallest
    doc_id, null last; of rows that tie in that too, one. keep_id is null where the row that stays has no doc_id. A very long text is
    one entry of its own. An empty table gives no rows. bits (8 to 64) shortens the hash, for tests of chains.
    """
    spark = docs.sparkSession
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    names = [c for c in keep or ["doc_id"] if c not in added]
    rows = common.stored(entries_of(docs, ["doc_id", *names], text, bits, buffer), "entries")
    entries = rows.filter(F.col("body").isNotNull()).select("entry", "h", "body")
    total = entries.agg(F.sum(F.length("body"))).first()[0] or 0
    slots, depth, n_buckets = directory(entries, capacity)
    owners = max(1, min(n_buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (64 << 20)))))
    links = common.stored(chained(entries, slots, depth, owners), "links")
    best = F.struct((-F.col("points")).alias("points"), F.col("kept_0").isNull().alias("none"), F.col("kept_0").alias("doc_id"), F.col("row").alias("row"))
    summed = rows.groupBy("entry").agg(F.count("*").alias("n"), F.min(best).alias("best")).join(links, "entry")
    classes = summed.groupBy("h", "link").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    known = links.join(classes, ["h", "link"]).select("entry", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    kept = [F.col(f"kept_{k + 1}").alias(c) for k, c in enumerate(names)]
    return rows.drop("body", "h").join(known, "entry").select(*kept, "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns; see groups()."""
    plain = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in plain.items()], F.col("doc_id"))
    return groups(named, keep=list(plain.values()), text=plain[text]).filter("kept").select(*[F.col(n).alias(c) for c, n in plain.items()])


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id, first(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER best = 1 AS kept, sha256(plain) AS text_sha256
FROM d WINDOW best AS (PARTITION BY plain ORDER BY length(text) DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
