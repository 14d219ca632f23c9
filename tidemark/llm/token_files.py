"""Token ids in Arrow stream files: fixed-size-list batches that a reader maps without copying; masks take a bit an id.

Documents are dealt by ranges of doc_id and sorted, so the files in order hold all documents in ascending doc_id order.
A file is one id stream cut into rows of row_length ids (column ids) with a mask of the same shape; only its last row is
padded. Any row is then at a fixed place: batch row // rows_per_batch, list row % rows_per_batch. Beside each file
stands a small index of doc_id and number of ids. Global starts come from one sum over the files' totals, one row a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, tokens
from tidemark.llm.spans import binary_list, blocks

ROW_LENGTH = 1024
ROWS_PER_BATCH = 1024
MANIFEST = "file_no long, path string, n_docs long, n_ids long"


def _list_batch(ids: np.ndarray, mask: np.ndarray, row_length: int) -> pa.RecordBatch:
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), row_length) for x in (ids, mask)]  # the mask takes a bit an id
    return pa.RecordBatch.from_arrays(lists, ["ids", "mask"])


class _Writer:
    """Collects ids and writes whole batches of rows as they fill."""

    def __init__(self, sink: pa.NativeFile, dtype: type, row_length: int, rows_per_batch: int):
        self.row_length, self.per_batch, self.dtype = row_length, row_length * rows_per_batch, dtype
        self.held: list[np.ndarray] = []
        self.size = 0
        empty = np.zeros(0, dtype)
        self.out = pa.ipc.new_file(sink, _list_batch(empty, empty.astype(bool), row_length).schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.size += len(ids)
        if self.size >= self.per_batch:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.per_batch * self.per_batch
            for a in range(0, whole, self.per_batch):
                part = flat[a : a + self.per_batch]
                self.out.write_batch(_list_batch(part, np.ones(len(part), bool), self.row_length))
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.row_length) * self.row_length, self.dtype)
            padded[: len(flat)] = flat
            self.out.write_batch(_list_batch(padded, np.arange(len(padded)) < len(flat), self.row_length))
        self.out.close()


class TokenFile:
    """Random access to the rows of one file; a row is a view of the mapped file."""

    def __init__(self, path: str):
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        local = isinstance(where, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(name) if local else where.open_input_file(name))
        with where.open_input_file(f"{name}.index") as index:
            self.index = pa.ipc.open_file(index).read_all()
        self.batches = self.reader.num_record_batches
        self.rows_per_batch = self.reader.get_batch(0).num_rows if self.batches else 0

    def ids(self, batch: int) -> np.ndarray:
        return self.reader.get_batch(batch).column("ids").values.to_numpy(zero_copy_only=True)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, at = divmod(i, self.rows_per_batch)
        got = self.reader.get_batch(batch)
        n = got.schema.field("ids").type.list_size
        ids, mask = (got.column(c).values.slice(at * n, n) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, row_length: int = ROW_LENGTH, rows_per_batch: int = ROWS_PER_BATCH, wide: bool = False) -> DataFrame:
    """Write docs (doc_id, text; other columns are left out) under folder; return the stored list of files.

    Null and empty texts hold the end id alone. Rows that share a doc_id stay separate, in the order of a hash of their texts, and may lie in several files;
    a null doc_id comes first. An empty table writes no ids. ids are 16-bit unless wide; a vocabulary that needs more is an
    error then. A task writes under a name of
    its own attempt and renames at the end, so a repeated task leaves whole files.
    """
    dtype = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}.arrow"
        own = f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        known = tokens.encoder(tokenizer_path)
        if max(known.vocabulary - 1, end_id) > np.iinfo(dtype).max:
            raise ValueError(f"{known.vocabulary} ids do not fit into {np.dtype(dtype).name}: write them wide")
        encode = known.encode
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        with where.open_output_stream(own) as sink:
            writer = _Writer(sink, dtype, row_length, rows_per_batch)
            for batch in batches:
                texts, ids = binary_list(batch.column("text")), batch.column("doc_id").to_pylist()
                for a, b in blocks(texts, tokens.BLOCK_BYTES):
                    flat, counts = encode(texts[a:b], end_id)
                    writer.add(flat)
                    doc_ids += ids[a:b]
                    lengths.append(counts)
            writer.close()
        counts = np.concatenate([*lengths, np.zeros(0, np.int64)])
        index = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": counts})
        with where.open_output_stream(f"{own}.index") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        for end in (".index", ""):
            where.move(own + end, name + end)
        yield pa.RecordBatch.from_pydict({"file_no": [task.partitionId()], "path": [f"{folder}/part-{task.partitionId():06d}.arrow"], "n_docs": [len(doc_ids)], "n_ids": [int(counts.sum())]})

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return common.stored(dealt.mapInArrow(run, MANIFEST), "token-files")


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row a document out of the files: doc_id, start (ids before it), n_tokens and crc32 of its ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                yield from documents(one["path"], one["base"])

    def documents(path: str, base: int) -> Iterator[pa.RecordBatch]:
        file = TokenFile(path)
        doc_ids, counts = file.index.column("doc_id"), file.index.column("n_tokens").to_numpy()
        ends, crcs, crc, done, seen = np.cumsum(counts), [], 0, 0, 0
        for k in range(file.batches):
            flat = file.ids(k).astype("<u4").tobytes()
            size = len(flat) // 4
            view, a = memoryview(flat), 0
            stops = ends[done : np.searchsorted(ends, seen + size, side="right")] - seen
            for b in stops.tolist():
                crcs.append(zlib.crc32(view[4 * a : 4 * b], crc))
                a, crc = b, 0
            crc = zlib.crc32(view[4 * a :], crc)
            done, seen = done + len(stops), seen + size
        yield pa.RecordBatch.from_arrays([doc_ids.combine_chunks(), pa.array(base + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.filter("n_docs > 0").select("file_no", "path", F.coalesce(before, F.lit(0)).alias("base"))
    n = max(1, manifest.count())
    return files.repartition(n).select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = common.fresh_dir(spark, "arrow")
    return read_documents(write_token_files(docs, folder, tokens.public_path("byte_bpe_50k.json"), end_id=0))
