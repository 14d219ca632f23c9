"""Benchmark decontamination: an FM-index for every training shard, searched for windows of the test items.

A shard is a block of documents of about shard_bytes inside a task; a longer document is a shard of its own. All words of
its documents are indexed, once. Test windows are searched backwards through the wavelet tree, occurrences are located
from sampled suffix positions, and their word ranges are merged into removal spans. No row is shuffled, so a passage that
a third of all documents share costs no more than its occurrences.

Test items are a stated query set. Tasks over the items write their windows to the shared folder in blocks of about
query_bytes of text each; a task over documents holds one index and one block at a time, however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidemark.llm import common
from tidemark.llm.fm_index import FMIndex
from tidemark.llm.spans import Block, binary_list, blocks, distinct, runs, spread

WINDOW = 13
SHARD_BYTES = 2 << 20
QUERY_BYTES = 8 << 20
#: Windows that a shard searches at once.
SLICE = 1 << 15
FOUND = StructType([
    StructField("n_words", LongType()), StructField("hit_words", LongType()), StructField("items", ArrayType(StringType())),
    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))),
])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

_WORD = np.ones(256, bool)
_WORD[:128] = [chr(b).isdigit() or "a" <= chr(b) <= "z" for b in range(128)]


def _words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    return runs(_WORD[block.data[: block.size]])


class Queries:
    """Windows of a block of items as arrays: the block's words by number, and where each window begins.

    No window is copied: it is a place in the row of words and the item it lies in. Windows that occur twice are
    brought together by a shard, for those that it may hold.
    """

    ARRAYS = {"sizes": np.int32, "symbols": np.int32, "starts": np.int32, "owners": np.int32, "lengths": np.int32}

    def __init__(self, item_ids: list[str | None], vocabulary: bytes, **arrays: np.ndarray):
        self.item_ids, self.vocabulary = item_ids, vocabulary  # words with a blank after each
        self.sizes, self.symbols, self.starts, self.owners, self.lengths = (arrays[k] for k in self.ARRAYS)

    @classmethod
    def of(cls, item_ids: list[str | None], texts: list[bytes], window: int) -> Queries:
        block = Block(texts, lower=True)
        start, length = _words(block)
        owner = np.searchsorted(block.starts, start, side="right") - 1
        codes, lead = distinct(block, start, length)
        vocabulary = b"".join([block.cut(a, n) + b" " for a, n in zip(start[lead].tolist(), length[lead].tolist(), strict=True)])
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        words = np.diff(first)
        size = np.minimum(words, window)
        places = np.where(size > 0, words - size + 1, 0)
        arrays = (length[lead], codes, spread(first[:-1], places), np.repeat(np.arange(len(texts)), places), np.repeat(size, places))
        return cls(item_ids, vocabulary, **{k: v.astype(t) for (k, t), v in zip(cls.ARRAYS.items(), arrays, strict=True)})

    def write(self, sink: pa.NativeFile) -> None:
        columns = {"item_ids": pa.array([self.item_ids], pa.list_(pa.string())), "vocabulary": pa.array([self.vocabulary], pa.large_binary())}
        columns |= {k: pa.array([getattr(self, k).tobytes()], pa.large_binary()) for k in self.ARRAYS}
        batch = pa.RecordBatch.from_pydict(columns)
        with pa.ipc.new_file(sink, batch.schema) as out:
            out.write_batch(batch)

    @classmethod
    def read(cls, path: str) -> Queries:
        """The block in a file; from a local folder it is mapped, so that all workers of a machine share its pages."""
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        source = pa.memory_map(name) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(name)
        batch = pa.ipc.open_file(source).get_batch(0)
        array = {k: np.frombuffer(batch.column(k)[0].as_buffer(), t) for k, t in cls.ARRAYS.items()}
        return cls(batch.column("item_ids")[0].as_py(), batch.column("vocabulary")[0].as_buffer().to_pybytes(), **array)


def _query_files(items: DataFrame, window: int, query_bytes: int) -> list[str]:
    """Paths of the blocks of windows; the driver sees the paths alone."""
    folder = common.fresh_dir(items.sparkSession, "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        ids: list[str | None] = []
        texts: list[bytes] = []
        paths: list[str] = []
        size = 0

        def write() -> None:
            name = f"block-{TaskContext.get().taskAttemptId()}-{len(paths)}"
            with where.open_output_stream(f"{root}/{name}", compression=None) as sink:
                Queries.of(ids, texts, window).write(sink)
            paths.append(f"{folder}/{name}")

        for batch in batches:
            for i, t in zip(batch.column("item_id").to_pylist(), binary_list(batch.column("text")), strict=True):
                if size > query_bytes:
                    write()
                    ids, texts, size = [], [], 0
                if t:
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
        if texts:
            write()
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    found = common.mapped(items.select(F.col("item_id").cast("string"), F.col("text").cast("string")), run, "path string")
    return sorted(r.path for r in found.collect())


@lru_cache(maxsize=1)
def _queries(path: str) -> Queries:
    """One block of windows; a worker keeps the last one."""
    return Queries.read(path)


class Shard:
    """Documents with an FM-index over all their words."""

    def __init__(self, texts: list[bytes]):
        self.block = Block(texts, lower=True)
        self.start, self.length = _words(self.block)
        self.first = np.searchsorted(self.start, np.append(self.block.starts, self.block.size))
        self.hit = np.zeros(len(self.start) + 1, np.int64)
        self.items: dict[int, set[str | None]] = {}
        if not len(self.start):
            return
        codes, lead = distinct(self.block, self.start, self.length)
        # every document is a stretch with an end behind it; word gives the word at each place of the index
        self.word = np.insert(np.arange(len(self.start)), self.first[1:], -1)
        self.index = FMIndex(np.insert(codes + 1, self.first[1:], 0), len(lead))
        hashes = self.block.hashes(self.start[lead], self.length[lead])
        self.order = np.argsort(hashes, kind="stable")
        self.lead, self.hashes = lead[self.order], hashes[self.order]

    def symbols(self, vocabulary: bytes, sizes: np.ndarray) -> np.ndarray:
        """The index's symbol of each word, 0 for a word that no document here has."""
        out = np.zeros(len(sizes), np.int64)
        block = Block([self.block.raw[: self.block.size], vocabulary])
        sizes = sizes.astype(np.int64)
        at = block.starts[1] + np.cumsum(sizes + 1) - sizes - 1
        hashes = block.hashes(at, sizes)
        place, left = np.searchsorted(self.hashes, hashes), np.arange(len(sizes))
        while len(left):  # more than once only where hashes collide
            left = left[place[left] < len(self.hashes)]
            left = left[self.hashes[place[left]] == hashes[left]]
            lead = self.lead[place[left]]
            same = (self.length[lead] == sizes[left]) & block.same(self.start[lead], at[left], sizes[left])
            out[left[same]] = self.order[place[left[same]]] + 1
            left = left[~same]
            place[left] += 1
        return out

    def search(self, queries: Queries) -> None:
        if not len(self.start) or not len(queries.starts):
            return
        symbols = self.symbols(queries.vocabulary, queries.sizes)[queries.symbols]
        unknown = np.concatenate(([0], np.cumsum(symbols == 0, dtype=np.int32)))
        whole = np.flatnonzero(unknown[queries.starts + queries.lengths] == unknown[queries.starts])
        for size in np.unique(queries.lengths[whole]).tolist():
            own = whole[queries.lengths[whole] == size]
            for a in range(0, len(own), SLICE):
                part = own[a : a + SLICE]
                self._windows(queries, symbols[queries.starts[part, None] + np.arange(size)], queries.owners[part])

    def _windows(self, queries: Queries, patterns: np.ndarray, owners: np.ndarray) -> None:
        """Hits and items of a slice of windows of one length; equal windows are searched once."""
        patterns, of = np.unique(patterns, axis=0, return_inverse=True)
        low, high = self.index.search(patterns)
        found = np.flatnonzero(high > low)
        if not len(found):
            return
        counts = high[found] - low[found]
        at = self.word[self.index.locate(spread(low[found], counts))]
        np.add.at(self.hit, at, 1)
        np.add.at(self.hit, at + patterns.shape[1], -1)
        docs = np.searchsorted(self.first, at, side="right") - 1
        pairs = np.unique(docs * len(patterns) + np.repeat(found, counts))
        docs, kinds = pairs // len(patterns), pairs % len(patterns)
        order = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[order], np.arange(len(patterns) + 1))
        many = np.diff(begin)[kinds]
        items = owners[order[spread(begin[kinds], many)]].astype(np.int64)
        both = np.unique(np.repeat(docs, many) * len(queries.item_ids) + items)
        for d, i in zip((both // len(queries.item_ids)).tolist(), (both % len(queries.item_ids)).tolist(), strict=True):
            self.items.setdefault(d, set()).add(queries.item_ids[i])

    def rows(self) -> Iterator[tuple[int, int, list[str | None], list[dict]]]:
        """(words, hit words, items, merged byte spans) of each document."""
        covered = np.cumsum(self.hit[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        for d, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            spans = []
            if d in self.items:
                at, n = runs(covered[a:b])
                begin, last = self.start[a + at] - self.block.starts[d], a + at + n - 1
                stop = self.start[last] + self.length[last] - self.block.starts[d]
                spans = [{"start": x, "stop": y} for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
            yield b - a, int(total[b] - total[a]), sorted(self.items.get(d, ()), key=lambda i: (i is None, i or "")), spans


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every row (doc_id unless named) with n_words, hit_words, the ids of items found as strings, and
    merged spans to remove as UTF-8 byte offsets.

    docs needs doc_id and text, items item_id and text; columns of those four names are replaced. Null and empty texts
    have no words; an item without words is never found. Items that share an id are one; items with a null id are one
    null in the list. Repeated rows count each for itself; a null doc_id is kept. A text of any length is searched whole.
    Empty tables give no hits or no rows.
    """
    paths = _query_files(items, window, query_bytes)
    names = [c for c in keep or ["doc_id"] if c not in FOUND.names]
    base = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias(text := common.unused(names, "searched")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_list(batch.column(text))
            for a, b in blocks(texts, shard_bytes):
                shard = Shard(texts[a:b])
                for path in paths:
                    shard.search(_queries(path))
                words, hits, found, spans = zip(*shard.rows(), strict=True)
                arrays = [pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in names], *arrays], [*names, *FOUND.names])

    return common.mapped(base, run, StructType([*[base.schema[c] for c in names], *FOUND.fields]))


def is_contaminated() -> Column:
    """At least a twentieth of the words are hit."""
    return (F.col("hit_words") > 0) & (20 * F.col("hit_words") >= F.col("n_words"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", F.col("hit_words").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), is_contaminated().alias("contaminated"))
