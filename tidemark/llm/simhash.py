"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is the majority of the bits of its shingles' XXH64. Its 64 bits are split into blocks; two fingerprints
that differ in at most `distance` bits agree in at least blocks - distance of them, so joining on every such choice of
blocks loses no pair. Fingerprints are made distinct before that, so copies never meet each other.

Members of one block key are compared inside a task on a sorted run. A key with more than `tile` members is dealt into
tiles, pairs of member groups, that hold at most two groups each; so no task holds an unbounded key. What leaves a
tile is a spanning forest of its links, never all pairs. Components of the forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import components
from tidemark.llm.spans import binary_list

SHINGLE = 3
DISTANCE = 3
BLOCKS = 5
TILE = 8192
SEED = 42

#: of wide fingerprints, for texts that share most of their shingles
SIMILAR_WORDS = 5
SIMILARITY = 0.8
WORDS = 8
BLOCK_BYTES = 2
ONES = np.uint64(0x0101010101010101)
STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, in order; of a shorter text, of all its words; of none, nothing."""
    import xxhash

    words = text.lower().split()  # bytes: A to Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    last = len(words) - size + 1
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, last)


def _fingerprint(text: bytes, shingle: int) -> int:
    hashes = _hashes(text, shingle)
    last = len(hashes)
    counts = np.zeros(64, np.int64)
    for a in range(0, last, 65536):  # bounded for very long texts
        bits = np.unpackbits(hashes[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > last).tolist()))


def _wide_fingerprint(text: bytes, shingle: int) -> bytes:
    """Majorities of WORDS x 64 bits that follow from each distinct shingle's hash; all zero without words."""
    hashes = np.unique(_hashes(text, shingle))
    counts = np.zeros((8, WORDS, 8), np.int64)
    for a in range(0, len(hashes), 255):  # a byte holds the count of one bit over 255 hashes
        x = hashes[a : a + 255, None] + STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        for bit in range(8):
            counts[bit] += ((x >> np.uint64(bit)) & ONES).sum(axis=0, dtype=np.uint64).astype("<u8").view(np.uint8).reshape(WORDS, 8)
    return np.packbits(2 * counts > len(hashes), axis=0, bitorder="little").tobytes()


def distance_of(similarity: float, bits: int = 64 * WORDS) -> int:
    """Bits in which fingerprints of two equally long texts of this Jaccard similarity differ, and one deviation more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + np.sqrt(bits * share * (1 - share)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str | None = None) -> DataFrame:
    """(doc_id, fp as a signed long) of every row, with the long column key if named; null and empty texts have fingerprint 0."""
    kept = ["doc_id", *([key] if key else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((_fingerprint(t, shingle) for t in binary_list(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found.view(np.int64))], [*kept, "fp"])

    return common.mapped(docs.select(*[F.col(c).cast("long") for c in kept], F.col("text").cast("string")), run, ", ".join(f"{c} long" for c in [*kept, "fp"]))


def block_keys(fp: str, distance: int, blocks: int) -> Column:
    """Array of keys: the choice of blocks that are held, and the bits of the fingerprint in them."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    keys = []
    for number, held in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(masks[k] for k in held)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), F.col(fp).bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, each a 64-bit number or a row of them."""
    bits = np.bitwise_count(x ^ y)
    return bits.sum(axis=-1, dtype=np.int64) if bits.ndim > 1 or x.ndim > 1 else bits


def _numbers(fps: pa.Array) -> np.ndarray:
    """Fingerprints as 64-bit numbers; of binary ones, a row of numbers each."""
    if pa.types.is_integer(fps.type):
        return fps.to_numpy(zero_copy_only=False).view(np.uint64)
    return np.frombuffer(b"".join(fps.to_pylist()), "<u8").reshape(len(fps), -1)


def _forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links among distinct fingerprints: (vertex, earlier vertex) index pairs."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            now = front.pop()
            near = _apart(fps[left], fps[now]) <= distance
            if near.any():
                got = left[near].tolist()
                a += got
                b += [now] * len(got)
                front += got
                left = left[~near]
    return a, b


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Forest links (a, b) of representatives among distinct (fp, rep) rows that differ in at most distance bits."""
    keyed = _keyed(distinct, block_keys("fp", distance, blocks))
    sizes = keyed.groupBy("choice", "bits").count().filter("count > 1")
    return _joined(keyed.join(sizes, ["choice", "bits"]), distance, tile)


def wide_links(distinct: DataFrame, distance: int, tile: int = TILE) -> DataFrame:
    """As links(), of binary fingerprints that share a block of BLOCK_BYTES bytes: certain up to one bit less than blocks."""
    size = F.length("fp") / BLOCK_BYTES
    keys = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda k: F.struct(
        k.alias("choice"), F.conv(F.hex(F.substring(F.col("fp"), k * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES))), 16, 10).cast("long").alias("bits")))
    keyed = _keyed(distinct, keys)
    # a key beyond a tile is rare, so only those are looked up; stored, so that Spark knows how many they are
    hot = common.stored(keyed.groupBy("choice", "bits").count().filter(F.col("count") > tile), "hot-blocks")
    return _joined(keyed.join(hot, ["choice", "bits"], "left").fillna(1, ["count"]), distance, tile)


def _keyed(distinct: DataFrame, keys: Column) -> DataFrame:
    return distinct.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", F.col("k.choice").alias("choice"), F.col("k.bits").alias("bits"))


def _joined(sized: DataFrame, distance: int, tile: int) -> DataFrame:
    """Forest links within every (choice, bits) of rows (fp, rep, choice, bits, count)."""
    parts = F.ceil(F.col("count") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = (
        sized.withColumn("parts", parts)
        .withColumn("own", own)
        .select("fp", "rep", "choice", "bits", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("own", j) * F.col("parts") + F.greatest("own", j))).alias("tile"))
        .repartition("choice", "bits", "tile")
        .sortWithinPartitions("choice", "bits", "tile", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            choice, bits, tile_no, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "bits", "tile", "rep"))
            now = [choice, bits, tile_no, _numbers(batch.column("fp")), rep]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = _last_run(now)
            yield from linked([x[:cut] for x in now])
            rest = [x[cut:] for x in now]
        if rest is not None:
            yield from linked(rest)

    def _last_run(cols: list[np.ndarray]) -> int:
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) if len(cols[0]) > 1 else []
        return int(change[-1]) + 1 if len(change) else 0

    def linked(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(cols[0]) < 2:
            return
        fps, reps = cols[3], cols[4]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
        start = np.concatenate(([0], change))
        length = np.diff(np.append(start, len(fps)))
        a, b = [], []
        for size in range(2, 7):  # by far the most
            few = start[length == size]
            for i, j in combinations(range(size), 2) if len(few) else ():
                near = few[_apart(fps[few + i], fps[few + j]) <= distance]
                a += reps[near + i].tolist()
                b += reps[near + j].tolist()
        for at, n in zip(start[length > 6].tolist(), length[length > 6].tolist(), strict=True):
            x, y = _forest(fps[at : at + n], distance)
            a += reps[at : at + n][x].tolist()
            b += reps[at : at + n][y].tolist()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return common.mapped(tiles, run, "a long, b long")


def linked(found: DataFrame, distance: int, blocks: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Of rows with fp: (fp, rep), rep being the least doc_id, and (fp, component, the least linked fp) of fingerprints with links."""
    distinct = common.stored(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    return distinct, components(links(distinct.select("fp", F.col("fp").alias("rep")), distance, blocks, tile)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row a document: doc_id, fp (long), component_id, the least doc_id that links reach, its own included.

    docs needs doc_id and text; other columns are left out. Null, empty and blank texts share fingerprint 0 and so one
    component. Equal texts and repeated rows are one component. A row with a null doc_id links like any other; its
    component_id is null only where no row of its component has a doc_id. An empty table gives no rows.

    Keys of two of five blocks have about 25 bits, so from about a billion unlike fingerprints on each key has tens of
    members and comparisons grow with the square; blocks=6, keys of three blocks, about 32 bits, has twenty keys a
    fingerprint instead of ten, and the same result.
    """
    found = common.stored(fingerprints(docs, shingle), "fingerprints")
    distinct, component = linked(found, distance, blocks, tile)
    both = common.stored(distinct.join(component, "fp"), "linked-fingerprints")
    # stored, so that Spark splits the join at a large component
    least = common.stored(both.groupBy("component").agg(F.min("rep").alias("least")), "components")
    # stored for the same reason: a large group of copies shares one fingerprint
    by_fp = common.stored(distinct.join(both.join(least, "component").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "component-ids")
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, nulls last, and of several the first stored.

    docs needs doc_id and text; all columns stay. Rows are told apart by a number of their own, so repeated rows leave
    one, and a doc_id that stands at two unlike texts keeps both. Null, empty and blank texts are one component. An empty
    table gives no rows.
    """
    key = common.unused(docs.columns, "row")
    numbered = common.stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered-documents")
    found = common.stored(fingerprints(numbered, shingle, key), "fingerprints")
    _, component = linked(found, distance, blocks, tile)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", key)).alias("first")
    kept = found.join(component, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(first).select(f"first.{key}")
    return numbered.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_WORDS, tile: int = TILE) -> DataFrame:
    """As one_of_each(), of texts whose sets of five-word shingles have a Jaccard similarity of about 0.8 or more.

    Fingerprints are 512 bits wide, since in 64 the distance says too little of a similarity; two that differ in at most
    distance_of(similarity) bits link. They are found by 32 blocks of 16 bits: up to 31 differing bits, a similarity of
    about 0.93, some block surely agrees; at 0.8 one does in nine cases of ten. Rows and nulls are treated as there.
    Comparisons in a block grow with the square of the corpus over 65,536: from some 100 million unlike texts on, raise
    WORDS and BLOCK_BYTES together.
    """
    key = common.unused(docs.columns, "row")
    numbered = common.stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered-documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_wide_fingerprint(t, shingle) for t in binary_list(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(key), found], ["doc_id", "row", "fp"])

    rows = common.mapped(numbered.select(F.col("doc_id").cast("long"), key, F.col("text").cast("string")), run, "doc_id long, row long, fp binary")
    found = common.stored(rows.withColumn("first", F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "row")), "wide-fingerprints")
    distinct = common.stored(found.groupBy("fp").agg(F.min("first").alias("first")).withColumn("rep", F.monotonically_increasing_id()), "distinct-fingerprints")
    component = components(wide_links(distinct.select("fp", "rep"), distance_of(similarity), tile)).withColumnRenamed("node", "rep")
    kept = distinct.join(component, "rep", "left").groupBy(F.coalesce("component", "rep").alias("component")).agg(F.min("first").alias("first"))
    # stored, so that Spark knows how many rows go and broadcasts only a short list
    gone = common.stored(found.select("row").join(kept.select(F.col("first.row").alias("row")), "row", "left_anti"), "repeated-rows")
    return numbered.join(gone.withColumnRenamed("row", key), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
