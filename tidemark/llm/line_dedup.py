"""Line dedup by content-defined chunks of lines.

A line ends at a line feed, after a word that ends in a full stop, question or exclamation mark, and, as running text may have
neither, after a word whose last eight bytes hash below those of the word before and not above those of the word after it, if
all of them stand in the same sentence. A rolling hash over the hashes of two lines chooses the chunks: one ends where
it is below that of the line before and not above that of the line after, so a chunk has two lines or more (the last of
a text may have one) and its bounds depend on four lines around them alone, whatever stands before the passage.

Chunks of several lines that stand elsewhere too, byte for byte, are seeds; their first place in the order of (doc_id,
text hash, number of the chunk) stays. Elsewhere seeds that follow one another as their first places do are one run. It
is extended to both sides, byte for byte and by whole words, as far as the first place reads alike, within the two chunks
beside it, and goes if it has min_words words or more then: one shared line of fewer stays, and so does a chunk alone.

Two passes over the text find the seeds: the first shuffles chunk hashes alone, counted before the shuffle. Repeated hashes become
a Bloom filter, sized by their count; where it would be larger than FILTER_BITS, the hashes of all chunks are joined with
the repeated ones instead. The second pass takes the text of chunks that pass the filter, and of two beside them, and groups the former:
equal groups are equal bytes, and what the filter let through by chance stands alone there. A passage that a third of all documents
share is summed up in each task first, and the joins after that are ones that Spark splits where keys are skewed. A third
pass extends and cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm import common
from tidemark.llm.spans import _MASK, Block, binary_list, blocks, runs

MIN_WORDS = 20
#: Bits of the largest Bloom filter, and bits a hash.
FILTER_BITS, BITS_A_HASH = 1 << 28, 16
FILTER_HASHES = 3
BLOCK_BYTES = 1 << 20
#: Chunks beside a seed that an extension may reach into, and bytes of each of them.
BESIDE, BESIDE_BYTES = 2, 512
#: Bytes of a span beyond which it is hashed by itself.
LONG = 256
#: Columns that dedup_lines adds.
ADDED = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Chunks:
    """Words, lines and chunks of a block; a text without words has none of them."""

    block: Block
    begin: np.ndarray  # of each word
    end: np.ndarray
    word: np.ndarray  # first word of each line
    line: np.ndarray  # first line of each chunk
    owner: np.ndarray  # text of each chunk
    number: np.ndarray  # within its text
    start: np.ndarray
    stop: np.ndarray  # end of its last word
    after: np.ndarray  # where the next chunk starts, or the end of the text
    lines: np.ndarray
    hash: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K1
    return x ^ (x >> np.uint64(29))


def _least(rank: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Whether a rank is below the one before and not above the one after; joined: whether a place belongs with the one before."""
    out = np.zeros(len(rank), bool)
    if len(rank) > 2:
        out[1:-1] = joined[1:-1] & joined[2:] & (rank[1:-1] < rank[:-2]) & (rank[1:-1] <= rank[2:])
    return out


def _span_hashes(block: Block, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of spans; those beyond LONG bytes are hashed one by one, as all others would wait for the longest."""
    long = np.flatnonzero(length > LONG)
    h = block.hashes(start, np.minimum(length, LONG))
    for k in long.tolist():
        h[k] = xxhash.xxh64_intdigest(block.cut(int(start[k]), int(length[k])))
    return h


def chunk(texts: list[bytes]) -> Chunks:
    block = Block(texts, b"\n")
    data = block.data[: block.size]
    edge = np.diff((data > 32).astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    feeds, tail = np.flatnonzero(data == 10), data[end - 1]
    closed = (tail == 46) | (tail == 33) | (tail == 63)
    hard = np.ones(len(begin), bool)
    hard[1:] = closed[:-1] | (data[end[:-1]] == 10)
    wide = np.flatnonzero(begin[1:] - end[:-1] > 1)
    hard[wide + 1] |= np.searchsorted(feeds, begin[wide + 1]) != np.searchsorted(feeds, end[wide])
    seen = np.maximum(begin, end - 8)
    with np.errstate(over="ignore"):
        rank = _mix((block.eight(seen) & _MASK[end - seen]) * _K2)
    starts = hard.copy()
    starts[1:] |= _least(rank, ~hard)[:-1]
    word = np.flatnonzero(starts)
    a, b = begin[word], end[np.append(word[1:], len(begin)) - 1] if len(word) else end
    h = _span_hashes(block, a, b - a)
    text = np.searchsorted(block.starts, a, side="right") - 1
    joined = np.append(False, text[1:] == text[:-1])[: len(text)]
    with np.errstate(over="ignore"):
        rolling = h.copy()
        rolling[1:] += np.where(joined[1:], h[:-1] * _K1, np.uint64(0))
        rolling = _mix(rolling)
    starts = ~joined
    starts[1:] |= _least(rolling, joined)[:-1]
    line = np.flatnonzero(starts)
    owner, last = text[line], np.append(line[1:], len(word)) - 1
    start, stop = a[line], b[last] if len(line) else b
    after = block.ends[owner] if len(line) else stop
    same = np.flatnonzero(owner[1:] == owner[:-1])
    after[same] = start[same + 1]
    return Chunks(block, begin, end, word, line, owner, np.arange(len(line)) - np.searchsorted(owner, owner), start, stop, after, np.diff(np.append(line, len(word))), _span_hashes(block, start, stop - start))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Chunks]]:
    for batch in batches:
        texts = binary_list(batch.column("text"))
        for a, b in blocks(texts, BLOCK_BYTES):
            yield batch.slice(a, b - a), chunk(texts[a:b])


def _hashes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in _batches(batches):
            found, n = np.unique(c.hash[c.lines > 1].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["h", "n"])

    return common.mapped(docs.select("text"), run, "h long, n long")


def _filter(repeated: DataFrame, bits: int) -> bytes:
    """Bloom filter of the hashes: at most bits / 64 rows reach the driver, however many hashes there are."""
    places = F.explode(F.array(*[F.pmod(F.xxhash64("h", F.lit(k)), F.lit(bits)) for k in range(FILTER_HASHES)]))
    words = repeated.select(places.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    out = np.zeros(bits // 64, np.int64)
    for batch in words.toLocalIterator(prefetchPartitions=True):
        out[batch.w] = batch.v
    return out.tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__th", F.xxhash64("text"))


def _candidates(docs: DataFrame, repeated: DataFrame, most_bits: int) -> DataFrame:
    """(__id, __th, number, seed, chunk, gap): chunks of several lines with a repeated hash, those few that a filter lets through
    by chance, and the chunks beside both, which are no seeds and may be cut short; gap is what stands before the next chunk."""
    keyed = _keyed(docs).select("__id", "__th", "text")
    wanted = BITS_A_HASH * repeated.count()
    bits = 1 << max(16, (max(1, wanted) - 1).bit_length())
    shared = docs.sparkSession.sparkContext.broadcast(_filter(repeated, bits)) if wanted <= most_bits else None

    def texts(batch: pa.RecordBatch, c: Chunks, seeds: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, hashes, raw, n = batch.column("__id"), batch.column("__th"), c.block.raw, len(c.owner)
        seed, wanted = np.zeros(n, bool), np.zeros(n, bool)
        seed[seeds] = wanted[seeds] = True
        for k in range(1, BESIDE + 1):
            near = c.owner[k:] == c.owner[:-k]
            wanted[k:] |= seed[:-k] & near
            wanted[:-k] |= seed[k:] & near
        picked = np.flatnonzero(wanted)
        for a in range(0, len(picked), 8192):
            at = picked[a : a + 8192]
            owner = pa.array(c.owner[at])
            text = [raw[x:y] for x, y in zip(c.start[at].tolist(), c.stop[at].tolist(), strict=True)]
            gap = [raw[x:y] for x, y in zip(c.stop[at].tolist(), np.minimum(c.after[at], c.stop[at] + BESIDE_BYTES).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(owner), hashes.take(owner), pa.array(c.number[at].astype(np.int32)), pa.array(seed[at]), pa.array(text, pa.binary()), pa.array(gap, pa.binary())], ["__id", "__th", "number", "seed", "chunk", "gap"])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint64)
        for batch, c in _batches(batches):
            several = np.flatnonzero(c.lines > 1)
            places = np.stack([np.mod(_spark_hash(c.hash[several], k), bits) for k in range(FILTER_HASHES)])
            yield from texts(batch, c, several[np.all((table[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1), axis=0)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, c in _batches(batches):
            at = np.flatnonzero(c.lines > 1)
            owner = pa.array(c.owner[at])
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(owner), batch.column("__th").take(owner), pa.array(c.number[at].astype(np.int32)), pa.array(c.hash[at].view(np.int64))], ["__id", "__th", "number", "h"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, c in _batches(batches):
            first = np.searchsorted(c.owner, np.arange(batch.num_rows))
            numbers = batch.column("numbers").to_pylist()
            yield from texts(batch, c, np.concatenate([a + np.array(n, np.int64) for a, n in zip(first, numbers, strict=True)]) if numbers else first)

    out = "__id long, __th long, number int, seed boolean, chunk binary, gap binary"
    if shared:
        return common.mapped(keyed, filtered, out)
    places = common.stored(common.mapped(keyed, numbered, "__id long, __th long, number int, h long"), "line-places")
    numbers = places.join(repeated, "h").groupBy("__id", "__th").agg(F.collect_set("number").alias("numbers")).select(F.col("__id").alias("i"), F.col("__th").alias("t"), "numbers")
    return common.mapped(keyed.join(numbers, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__th") == F.col("t"))).select("__id", "__th", "text", "numbers"), joined, out)


def repeated_chunks(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(__id, __th, remove): chunks of each document that stand elsewhere and earlier, as structs of their number and, at the
    ends of a run that follows its first place chunk by chunk, the bytes to the left and right of that first place.
    """
    spark = docs.sparkSession
    counted = common.stored(_hashes(docs).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "repeated-lines")
    found = common.stored(_candidates(docs, counted, bits), "line-candidates")
    common.forget(spark, counted)
    seeds = found.filter("seed").withColumn("__id", F.coalesce("__id", F.lit(-(2**63))))
    place = F.struct(F.col("__id").alias("a"), F.col("__th").alias("b"), F.col("number").alias("c"))
    # stored, so that both sides of the joins below are plain exchanges, which Spark splits at a frequent chunk
    first = common.stored(seeds.groupBy("chunk").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"), "line-first")
    again = seeds.join(first, "chunk").filter(place != F.col("first")).select("__id", "__th", "number", "first.*").distinct()
    run = Window.partitionBy("__id", "__th").orderBy("number")
    follows = lambda by, k: F.coalesce((by("number", 1) == F.col("number") + k) & (by("a", 1) == F.col("a")) & (by("b", 1) == F.col("b")) & (by("c", 1) == F.col("c") + k), F.lit(False))
    ends = again.select("*", (~follows(lambda c, n: F.lag(c, n).over(run), -1)).alias("l"), (~follows(lambda c, n: F.lead(c, n).over(run), 1)).alias("r"))
    ends = common.stored(ends, "line-again")
    # what stands beside the first places that the ends of runs ask for
    asked = ends.filter("l or r").select("a", "b", "c").distinct().select("a", "b", "c", F.explode(F.sequence(F.lit(-BESIDE), F.lit(BESIDE))).alias("k"))
    parts = found.select(F.coalesce("__id", F.lit(-(2**63))).alias("a"), F.col("__th").alias("b"), "number", "chunk", "gap")
    near = asked.withColumn("number", F.col("c") + F.col("k")).join(parts, ["a", "b", "number"])
    part = lambda k, column: F.max(F.when(F.col("k") == k, column))
    none = F.lit(b"")
    left = F.concat(*[x for k in range(-BESIDE, 0) for x in (F.coalesce(part(k, F.col("chunk")), none), F.coalesce(part(k, F.col("gap")), none))])
    right = F.concat(F.coalesce(part(0, F.col("gap")), none), *[x for k in range(1, BESIDE + 1) for x in (F.coalesce(part(k, F.col("chunk")), none), F.coalesce(part(k, F.col("gap")), none))])
    beside = near.groupBy("a", "b", "c").agg(left.alias("left"), right.alias("right"))
    beside = beside.select("a", "b", "c", F.expr(f"right(left, {BESIDE_BYTES})").alias("left"), F.expr(f"left(right, {BESIDE_BYTES})").alias("right"))
    beside = common.stored(beside, "line-beside")
    common.forget(spark, found)
    asking = ends.filter("l or r").join(beside, ["a", "b", "c"], "left").select("__id", "__th", "number", F.when(F.col("l"), F.col("left")).alias("left"), F.when(F.col("r"), F.col("right")).alias("right"))
    rest = ends.filter("not (l or r)").select("__id", "__th", "number", F.lit(None).cast("binary").alias("left"), F.lit(None).cast("binary").alias("right"))
    return asking.unionByName(rest).groupBy("__id", "__th").agg(F.array_sort(F.collect_list(F.struct("number", "left", "right"))).alias("remove"))


def _spark_hash(h: np.ndarray, k: int) -> np.ndarray:
    """xxhash64(h, k) of Spark for longs h and an int k, as signed longs."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def end(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    with np.errstate(over="ignore"):
        x = np.uint64(42) + p5 + np.uint64(8)
        x = end(rot((rot(h * p2, 31) * p1) ^ x, 27) * p1 + p4)
        x = x + p5 + np.uint64(4)
        x = end(rot(x ^ (np.uint64(k) * p1), 23) * p2 + p3)
    return x.view(np.int64)


def _alike(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _left(c: Chunks, k: int, there: bytes) -> int:
    """First word of chunk k or of what reads alike before it and before its first place; a word counts if it is whole at both."""
    start, least = int(c.start[k]), int(c.block.starts[c.owner[k]])
    n = _alike(c.block.raw[max(least, start - len(there)) : start][::-1], there[::-1])
    a = int(np.searchsorted(c.begin, start - n))
    goes_on = there[len(there) - n - 1] > 32 if n < len(there) else len(there) == BESIDE_BYTES
    return a + bool(n and goes_on and c.begin[a] == start - n)


def _right(c: Chunks, k: int, there: bytes) -> int:
    """Word after chunk k and what reads alike after it."""
    stop, most = int(c.stop[k]), int(c.block.ends[c.owner[k]])
    n = _alike(c.block.raw[stop : min(most, stop + len(there))], there)
    b = int(np.searchsorted(c.end, stop + n, side="right"))
    goes_on = there[n] > 32 if n < len(there) else len(there) == BESIDE_BYTES
    return b - bool(n and goes_on and c.end[b - 1] == stop + n)


def _cut(c: Chunks, i: int, a: np.ndarray, b: np.ndarray) -> bytes:
    """Text i without the words of runs a to b. The space behind a run goes with it; that before it does if only the one behind holds a line feed."""
    raw, out, at, end = c.block.raw, [], int(c.block.starts[i]), int(c.block.ends[i])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        before = int(c.end[x - 1]) if x and c.end[x - 1] > at else at
        start, stop = int(c.begin[x]), int(c.end[y - 1])
        after = min(int(c.begin[y]), end) if y < len(c.begin) else end
        if before > at and b"\n" in raw[stop:after] and b"\n" not in raw[before:start]:
            start, after = before, stop
        out.append(raw[at:start])
        at = after
    return b"".join([*out, raw[at:end]])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = FILTER_BITS) -> DataFrame:
    """docs with text replaced by what is left, and columns n_lines, n_chunks, removed_chunks, removed_lines added.

    docs needs doc_id and text; other columns stay, except that columns of those four names are replaced. A null text
    stays null; it and texts without words have no lines. Rows that share doc_id and text are one document: all keep or lose the
    same chunks. Chunks that repeat inside one document count too. Lines and chunks count as removed if all their words
    are. Texts of any length are taken whole; an empty table gives no rows.
    """
    extra = ADDED
    base = docs.drop(*extra)
    gone = repeated_chunks(docs, bits)
    names, marks = base.columns, common.unused(base.columns, "remove")
    left, right = base.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("th")), gone
    joined = left.join(right, (F.col("id") == F.col("__id")) & (F.col("th") == F.col("__th")), "left").select("row.*", F.col("remove").alias(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, c in _batches(batches):
            texts = batch.column("text").to_pylist()
            first = np.searchsorted(c.owner, np.arange(batch.num_rows + 1))
            ends = np.append(c.word, len(c.begin))  # of lines, in words; the last entry ends the last
            bounds = ends[np.append(c.line, len(c.word))[first]]
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(marks)), 0).to_numpy()
            asked = batch.column(marks).flatten()
            k = np.repeat(first[:-1], sizes) + asked.field("number").to_numpy()
            ls, rs = asked.field("left"), asked.field("right")
            heads, tails = (np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) for x in (ls, rs))
            a = np.array([_left(c, k[x], y) for x, y in zip(heads.tolist(), ls.take(pa.array(heads)).to_pylist(), strict=True)], np.int64)
            b = np.array([_right(c, k[x], y) for x, y in zip(tails.tolist(), rs.take(pa.array(tails)).to_pylist(), strict=True)], np.int64)
            long = b - a >= min_words
            depth = np.zeros(len(c.begin) + 1, np.int64)
            np.add.at(depth, a[long], 1)
            np.add.at(depth, b[long], -1)
            gone = np.cumsum(depth)[:-1] > 0
            for i in np.flatnonzero(sizes).tolist():
                x, n = runs(gone[bounds[i] : bounds[i + 1]])
                if len(x):
                    texts[i] = _cut(c, i, x + bounds[i], x + n + bounds[i]).decode()
            before = np.concatenate(([0], np.cumsum(~gone)))
            line = before[ends[1:]] == before[ends[:-1]]
            whole = np.append(c.line, len(c.word))
            chunks = before[ends[whole[1:]]] == before[ends[whole[:-1]]]
            of = np.repeat(c.owner, c.lines)
            count = lambda owner, flags=None: pa.array(np.bincount(owner, flags, minlength=batch.num_rows).astype(np.int64))  # noqa: E731, B023
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, count(of), count(c.owner), count(c.owner, chunks), count(of, line)], [*names, *extra])

    return common.mapped(joined, run, StructType([*base.schema.fields, *[StructField(n, LongType()) for n in extra]]))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.encode("text", "UTF-8")
    return found.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("kept_bytes"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"))
