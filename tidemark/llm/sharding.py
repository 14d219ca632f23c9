"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked through their text: a hub, so a group of n copies has n links and no pairs. A
hub larger than half a shard is first split into parts of that size. Labels start from a hash, evenly. In each round
every hub names the shard that most of its documents have, documents elsewhere want to move there, and of each pair of
shards as many move one way as come back or as the target's quota has room for. Rounds go through the shared folder.

At the end every shard takes exactly its share: `rows` law, counts at most one apart. Linked documents beyond the share
and all unlinked ones fill the remaining places. Places come from a rank that is counted in buckets of a hash and summed
over a table of bounded size, so nothing is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

SHARDS = 16
ROUNDS = 3
#: Rows of a label are ranked in buckets: as many as a bucket of BUCKET_ROWS needs, between these bounds.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 10, 1 << 16


def _moves(state: DataFrame, hubs: DataFrame, shards: int, quota: int) -> dict[tuple[int, int], float]:
    """Shares of the documents that may move from one shard to another: a table of shards squared on the driver."""
    wanted = {(r.src, r.dst): r.n for r in state.join(hubs, "hub").filter("shard != best").groupBy(F.col("shard").alias("src"), F.col("best").alias("dst")).agg(F.count("*").alias("n")).collect()}
    room = {s: quota for s in range(shards)}
    for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect():
        room[r.shard] -= r.n
    out, spare = {}, {s: max(0, room[s]) for s in room}
    for (src, dst), n in sorted(wanted.items()):
        swap = min(n, wanted.get((dst, src), 0))
        out[src, dst] = swap
    for (src, dst), n in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - out[src, dst], spare[dst])
        out[src, dst] += more
        spare[dst] -= more
        spare[src] += more
    return {k: v / wanted[k] for k, v in out.items()}


def _best(state: DataFrame) -> DataFrame:
    """The shard with most documents of each hub; ties go to a shard that depends on the hub."""
    cells = state.groupBy("hub", "shard").agg(F.count("*").alias("n"))
    return cells.groupBy("hub").agg(F.max_by("shard", F.struct("n", F.xxhash64("hub", "shard"))).alias("best"))


def propagate(linked: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """linked (key, hub) -> (key, hub, shard) after rounds of quota-bound moves towards each hub's own shard."""
    state = common.stored(linked.select("key", "hub", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(shards)).cast("int").alias("shard")), "shards")
    for number in range(rounds):
        hubs = common.stored(_best(state), "shard-hubs")
        shares = _moves(state, hubs, shards, quota)
        if not shares:
            break
        table = F.create_map(*[F.lit(x) for (a, b), share in shares.items() for x in (a * shards + b, share)])
        chance = F.pmod(F.xxhash64("key", F.lit(100 + number)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        moves = (F.col("shard") != F.col("best")) & (chance < F.coalesce(F.try_element_at(table, F.col("shard") * shards + F.col("best")), F.lit(0.0)))
        state = common.stored(state.join(hubs, "hub").select("key", "hub", F.when(moves, F.col("best")).otherwise(F.col("shard")).alias("shard")), "shards")
    return state


def _ranked(rows: DataFrame, label: str, order: list[str], total: int) -> DataFrame:
    """rows with rank: 0, 1, ... within each label, in the order of a hash bucket and then of the order columns."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(min(max(total // BUCKET_ROWS, LEAST_BUCKETS), MOST_BUCKETS))).cast("int"))
    before = F.sum("n").over(Window.partitionBy(label).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(label, "bucket").agg(F.count("*").alias("n")).select(label, "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(label, "bucket").orderBy(*order)) - 1
    return rows.withColumn("within", within).join(F.broadcast(offsets), [label, "bucket"]).withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "within", "before")


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, shard, slot; counts of shards are at most one apart.

    docs needs doc_id and text; other columns are left out. Size is the text's UTF-8 bytes plus 1; a null text has size
    1 and crc32 of no bytes, and all null texts are one group, apart from empty ones. Repeated rows are documents each
    for itself. Fewer documents than shards leave shards empty; an empty table gives no rows. Which shard a document gets
    depends on its place in the input's files: another layout of the same rows gives other shards under the same law.
    """
    text = common.text_bytes()
    group = F.concat_ws(":", F.sha2(text, 256), F.col("text").isNull().cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.substring(group, 1, 32)).alias("g"), F.col("text").isNull().alias("missing"))
    # a document's key is its place in a stored table, so repeated rows differ and a repeated task finds the same keys
    rows = common.stored(rows, "shard-rows")
    rows = common.stored(rows.withColumn("key", F.monotonically_increasing_id()), "shard-keys")
    total = rows.count()
    quota = -(-total // shards)
    part_rows = max(1, quota // 2)
    # stored, so that both sides of the join below are plain exchanges, which Spark splits at a large group
    groups = common.stored(rows.groupBy("g", "missing").agg(F.count("*").alias("members")).filter("members > 1"), "shard-groups")
    parts = F.ceil(F.col("members") / part_rows)
    linked = rows.join(groups, ["g", "missing"]).select("key", F.xxhash64("g", "missing", F.pmod(F.xxhash64("key"), parts)).alias("hub"))
    state = propagate(linked, shards, quota, rounds)
    labelled = rows.join(state.select("key", "shard"), "key", "left").select("doc_id", "size", "text_crc32", "key", F.coalesce("shard", F.lit(shards)).alias("label"))
    ranked = common.stored(_ranked(labelled, "label", ["key"], total), "shard-ranks")
    held = {r.label: r.n for r in ranked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return _placed(ranked, held, total, shards)


def _case(values: dict[int, int], column: Column) -> Column:
    """The long that a small table of at most shards + 1 entries has for the column's value."""
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("long"))]), column)


def _placed(ranked: DataFrame, held: dict[int, int], total: int, shards: int) -> DataFrame:
    share = {s: total // shards + (s < total % shards) for s in range(shards)}
    stays = {s: min(held.get(s, 0), share[s]) for s in share} | {shards: 0}
    beyond, at = {}, 0  # where each label's overflow, and last the unlinked, start among those that fill up
    for s in [*range(shards), shards]:
        beyond[s] = at
        at += held.get(s, 0) - stays[s]
    starts, at = [], 0
    for s in range(shards):
        starts.append(at)
        at += share[s] - stays[s]
    label, rank = F.col("label"), F.col("rank")
    keep = rank < _case(stays, label)
    place = _case(beyond, label) + rank - _case(stays, label)
    filled = F.lit(0)
    for s in range(1, shards):
        filled = filled + (place >= starts[s]).cast("int")
    # shards without room share their start with the next one; the last shard with that start has the room
    out = ranked.withColumn("keep", keep).withColumn("place", place).withColumn("filled", filled.cast("int"))
    shard = F.when(F.col("keep"), label).otherwise(F.col("filled"))
    slot = F.when(F.col("keep"), rank).otherwise(F.col("place") - _case(dict(enumerate(starts)), F.col("filled")) + _case({s: stays[s] for s in range(shards)}, F.col("filled")))
    return out.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
