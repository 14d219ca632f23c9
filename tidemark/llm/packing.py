"""Packing: best-fit decreasing into fixed windows.

A document's ids, with an end id, are cut into full windows as long as they fill one; the rest of each document is one
piece. Pieces are placed longest first, each into the open window with the least capacity that still takes it. A
segment tree over remaining capacity finds that window in log2(window) steps.

Packing runs inside a task over groups of about group_tokens ids, so no row is shuffled and memory is bounded by the
group; a group leaves about one half-filled window. Groups follow the input's own partitions: a source or key that
holds a third of all rows makes no task longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, tokens
from tidemark.llm.spans import binary_list, blocks

WINDOW = 2048
GROUP_TOKENS = 4 << 20
PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Counts of open windows by remaining capacity, with the least sufficient capacity found from the root."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the least capacity of at least need."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window of each piece, offset there, number of windows); ties go by position, so the result is repeatable."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            capacity, at, used = window, used, used + 1
        else:
            capacity, at = found
        place[i], offset[i] = at, window - capacity
        if capacity > need:
            tree.add(capacity - need, at)
    return place, offset, used


def _pieces(doc_ids: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of every piece of documents with so many ids."""
    parts = -(-counts // window)
    row = np.repeat(np.arange(len(counts)), parts)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
    return row, start, np.minimum(window, counts[row] - start)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start and length in its document, its ids, the document's number of ids, window, offset.

    docs needs doc_id and text; other columns are left out. Null and empty texts are one piece that holds the end id.
    Documents that share a doc_id, and repeated rows, are packed each for itself. An empty table gives no rows.
    sequence_id is unique over the whole result: the task's number in its upper bits, a count within the task below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        encode = tokens.encoder(tokenizer_path).encode
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            doc_ids = np.array([x for ids, _, _ in held for x in ids], dtype=object)
            counts = np.concatenate([c for _, c, _ in held])
            flat = np.concatenate([f for _, _, f in held])
            row, start, length = _pieces(doc_ids, counts, window)
            at = (np.cumsum(counts) - counts)[row] + start
            place, offset, used = best_fit_decreasing(length, window)
            for a in range(0, len(row), 4096):
                cut = slice(a, a + 4096)
                lo, hi = int(at[a]), int(at[cut][-1] + length[cut][-1])  # pieces lie in the order of the ids
                bounds = np.append(at[cut] - lo, hi - lo).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[row[cut]], pa.int64()), pa.array(start[cut]), pa.array(length[cut]), pa.ListArray.from_arrays(bounds, pa.array(flat[lo:hi].astype(np.int32))), pa.array(counts[row[cut]]), pa.array(place[cut] + base), pa.array(offset[cut])],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            base += used
            held.clear()

        for batch in batches:
            texts, ids = binary_list(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in blocks(texts, tokens.BLOCK_BYTES):
                flat, counts = encode(texts[a:b], end_id)
                held.append((ids[a:b], counts, flat))
                size += len(flat)
                if size >= group_tokens:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return common.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed windows themselves: sequence_id, ids padded to the window, mask and document position arrays.

    One shuffle on sequence_id, whose groups hold at most one window of ids.
    """
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    fill = F.lit(window) - F.size("ids")
    return (
        joined.select("sequence_id", ids.alias("ids"), F.flatten(F.transform("p", lambda x: F.sequence(F.lit(0), F.size(x["ids"]) - 1))).alias("positions"))
        .select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), fill)).alias("ids"), F.concat("positions", F.array_repeat(F.lit(0), fill)).alias("positions"), F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), fill)).alias("mask"))
    )


def with_crc(pieces: DataFrame) -> DataFrame:
    """Replace ids by their crc32 as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            view, crc, a = memoryview(flat.tobytes()), [], 0
            for b in ends:
                crc.append(zlib.crc32(view[4 * a : 4 * b]))
                a = b
            yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if n == "ids_crc32" else batch.column(n) for n in names], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return common.mapped(pieces, run, PIECES.replace("ids array<int>", "ids_crc32 long"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return with_crc(pack(docs, tokens.public_path("word_bpe_49k.json"), end_id=1))
