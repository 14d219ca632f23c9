"""Merkle manifest of a dataset: one leaf a row, a binary tree for each group, one tree over the groups' roots.

Rows get their place within their group from a range partitioning and sums over partitions, so a group may hold any share of the rows.
Leaves then stand in arrays of BLOCK consecutive places. Higher-order functions collapse such an array level by level:
sequence and slice give the runs of two, transform hashes each run, aggregate stacks the levels. The block roots are the
leaves of the next pass, until every group is one block; passes grow with the logarithm of the largest group. On the way down each
block hands its children their siblings, so the part of a proof above a block is shared by its rows and never shuffled
with them. All of this is built-in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Leaves of a block, a power of two, and the levels that collapse them.
LEVELS = 8
BLOCK = 1 << LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(*fields: Column) -> Column:
    """H of fields, each '-' if null, else its UTF-8 byte count, ':' and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with place (from 0) and total, their place in and the size of their group; rows must be a stored table.

    Rows that are equal in order may change places with each other.
    """
    tie, at = common.unused(rows.columns, "tie"), common.unused(rows.columns, "at")
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(by, *order, tie).sortWithinPartitions(by, *order, tie).drop(tie)
    placed = common.stored(dealt.withColumn(at, F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright(at, 33))
    sums = placed.groupBy(by, "part").agg(F.count("*").alias("n"), F.min(at).alias("low"))
    group = Window.partitionBy(by)
    earlier = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(by, "part", (earlier - F.col("low")).alias("shift"), F.sum("n").over(group).alias("total"))
    return placed.join(sums, [by, "part"]).withColumn("place", F.col(at) + F.col("shift")).drop(at, "part", "shift")


_LAST = "element_at(seen, -1)"
_STACK = f"""aggregate(sequence(1, {LEVELS}), array(items.node), (seen, level) ->
  if(lone AND size({_LAST}) = 1, seen, concat(seen, array(
    transform(sequence(1, cast((size({_LAST}) + 1) div 2 AS int)), k -> sha2(array_join(slice({_LAST}, 2 * k - 1, 2), ''), 256))))))"""

#: The sibling of child i at every level of its block, after a letter for its side; '' where the run is i's node alone.
_SIBLINGS = """transform(slice(levels, 1, size(levels) - 1), (level, j) -> CASE
  WHEN shiftright(i, j) & 1 = 1 THEN concat('L', element_at(level, shiftright(i, j)))
  WHEN shiftright(i, j) + 1 < size(level) THEN concat('R', element_at(level, shiftright(i, j) + 2)) ELSE '' END)"""


def _passes(nodes: DataFrame, *payload: str) -> list[DataFrame]:
    """nodes: g, place, total, node and payload -> blocks of each pass: g, block, lone, items, levels, total, root.

    The blocks of a group that is one block are lone; the last pass has only such.
    """
    out: list[DataFrame] = []
    while True:
        items = F.array_sort(F.collect_list(F.struct("place", "node", *payload)))
        grouped = nodes.groupBy("g", F.expr(f"place div {BLOCK}").alias("block"), "total").agg(items.alias("items")).withColumn("lone", F.col("total") <= BLOCK)
        blocks = common.stored(grouped.withColumn("levels", F.expr(_STACK)).withColumn("root", F.expr("element_at(element_at(levels, -1), 1)")), "blocks")
        out.append(blocks)
        if (blocks.agg(F.max("total")).first()[0] or 0) <= BLOCK:
            return out
        nodes = blocks.filter("NOT lone").select("g", F.col("block").alias("place"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col("root").alias("node"))
        payload = ()


def _tops(passes: list[DataFrame]) -> DataFrame:
    """(g, node): the root of each group."""
    out = passes[0].filter("lone").select("g", F.col("root").alias("node"))
    for blocks in passes[1:]:
        out = out.unionByName(blocks.filter("lone").select("g", F.col("root").alias("node")))
    return out


def _down(passes: list[DataFrame], above: DataFrame, *payload: str) -> DataFrame:
    """above: g, top, path of each group's root -> g, top, path, place, node and payload of every node of the first pass."""
    above = above.select("g", F.lit(0).cast("long").alias("block"), F.lit(True).alias("lone"), "top", F.col("path").alias("rest"))
    inner = None
    for k, blocks in reversed(list(enumerate(passes))):
        known = above if inner is None else above.unionByName(inner)
        names = ["place", "node", *(payload if k == 0 else ())]
        child = ", ".join(f"item.{c} AS {c}" for c in names)
        paths = F.expr(f"transform(items, (item, i) -> struct({child}, concat({_SIBLINGS}, rest) AS path))")
        found = blocks.join(known, ["g", "block", "lone"]).select("g", "top", F.inline(paths))
        inner = found.select("g", F.col("place").alias("block"), F.lit(False).alias("lone"), "top", F.col("path").alias("rest"))
    return found


def manifest(rows: DataFrame, leaf: Column, now: Column, group: Column, order: str) -> DataFrame:
    """order, leaf, subroot, root, path, proof_sha256, folded_root, verified: the proof of every row.

    leaf is what the tree holds, now the leaf to check against it. Rows of a group (null is one) ascend by order, null first; rows equal in
    order by their leaves. Group roots ascend by group, null first, bytewise. path lists siblings upwards, each after
    L or R for its side, '' where a run is one node. A table of one row has that leaf as root and an empty path; an empty table gives no rows.
    A text of any length is hashed inside its row.
    """
    key = F.coalesce(F.concat(F.lit(":"), group.cast("string")), F.lit(""))
    leaves = common.stored(rows.select(key.alias("g"), F.col(order).alias("id"), leaf.alias("node"), now.alias("now")), "leaves")
    trees = _passes(numbered(leaves, "g", "id", "node"), "id", "now")
    tops = common.stored(_tops(trees), "subroots").select(F.lit("").alias("g"), F.col("g").alias("name"), "node")
    over = _passes(numbered(tops, "g", "name"), "name")
    top = over[-1].select("root").first()
    root = F.lit(top[0] if top else None).cast("string")
    none = rows.sparkSession.range(1).select(F.lit("").alias("g"), F.lit("").alias("top"), F.array().cast("array<string>").alias("path"))
    named = _down(over, none, "name").select(F.col("name").alias("g"), F.col("node").alias("top"), "path")
    proofs = _down(trees, named, "id", "now")
    folded = F.expr("aggregate(path, now, (acc, p) -> sha2(CASE left(p, 1) WHEN 'L' THEN concat(substr(p, 2), acc) WHEN 'R' THEN concat(acc, substr(p, 2)) ELSE acc END, 256))")
    checked = proofs.select(F.col("id").alias(order), F.col("node").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), "path", folded.alias("folded_root"))
    proof = F.expr("sha2(array_join(transform(path, p -> substr(p, 2)), ''), 256)")
    return checked.withColumn("proof_sha256", proof).withColumn("verified", F.col("folded_root") == F.col("root"))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """manifest() of the columns of documents by lang; rows whose doc_id's checksum 7 divides are checked with n_chars one higher.

    Other columns pass by. Repeated rows are leaves each for itself. A null doc_id comes first and is not tampered with; a null n_chars stays.
    """
    fields = [F.col(c) for c in FIELDS]
    higher = [(F.col(c).cast("decimal(20,0)") + 1).cast("string") if c == "n_chars" else F.col(c) for c in FIELDS]
    leaf = leaf_of(*fields)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return manifest(docs, leaf, F.when(tampered, leaf_of(*higher)).otherwise(leaf), F.col("lang"), "doc_id")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_manifest(common.table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_HIGHER = "sha256(" + " || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS) + ")"
_UP = "SELECT g, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {0} WHERE n > 1 GROUP BY g, level, pos // 2"
#: The checksum that picks tampered rows, bit by bit: DuckDB has no CRC-32.
_CRC = """list_reduce([4294967295] || list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])::BIGINT),
  lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce(':' || lang, '') AS g, {_LEAF} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN {_HIGHER} ELSE {_LEAF} END AS now
  FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
up(g, level, pos, node, n) AS (SELECT g, 0, pos, leaf, n FROM placed UNION ALL {_UP.format('up')}),
low AS MATERIALIZED (SELECT * FROM up),
tops AS MATERIALIZED (SELECT g AS name, level, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
over(g, level, pos, node, n) AS (SELECT '', 0, pos, node, n FROM tops UNION ALL {_UP.format('over')}),
high AS MATERIALIZED (SELECT * FROM over),
tree AS MATERIALIZED (
  SELECT l.g, l.level, l.pos, l.node, l.n FROM low l WHERE l.n > 1
  UNION ALL SELECT t.name, t.level + h.level, h.pos, h.node, h.n FROM tops t JOIN high h ON h.n > 1),
walk(doc_id, g, leaf, level, pos, acc, proof, depth, top_pos) AS (
  SELECT p.doc_id, p.g, p.leaf, 0, p.pos, p.now, '', t.level, t.pos FROM placed p JOIN tops t ON t.name = p.g
  UNION ALL
  SELECT w.doc_id, w.g, w.leaf, w.level + 1, place // 2,
    sha256(CASE WHEN s.node IS NULL THEN acc WHEN place % 2 = 1 THEN s.node || acc ELSE acc || s.node END), proof || coalesce(s.node, ''), depth, top_pos
  FROM (SELECT *, CASE WHEN level = depth THEN top_pos ELSE pos END AS place FROM walk) w
  JOIN tree own ON own.g = w.g AND own.level = w.level AND own.pos = place
  LEFT JOIN tree s ON s.g = w.g AND s.level = w.level AND s.pos = xor(place, 1))
SELECT doc_id, leaf, t.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.node AS verified
FROM walk w JOIN tops t ON t.name = w.g JOIN high r ON r.n = 1 AND w.level = t.level + r.level
"""
