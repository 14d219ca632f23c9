"""WARC archives with segmented records: writing pages, and reading them back whole.

write_pages() makes a record a page. Of equal payloads the one with the least page_id is stored as a response, the
others as revisits that refer to it. A response's HTTP block has its body in chunked transfer framing; a block above
segment_bytes goes into several records: the first with segment number 1, then continuations that carry the first
record's identifier, the last with the total length. A task writes one gzip-per-record file; continuations of a block
go to a second file of the task, as they do when an archive file fills up.

read_pages() parses every file in tasks, groups continuation records by their origin, orders them by segment number,
verifies the total length, and decodes the chunked framing. Only segments of divided records are shuffled; a group is
one record.

Equal payloads are found by a count over digests, summed before the shuffle, and a join of keys that Spark splits where
a digest is frequent; so one payload may hold a third of all pages.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.spans import binary_list

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Compressed bytes that a reader takes at a time.
WINDOW_BYTES = 4 << 10
#: So many revisits are told to all tasks; beyond that pages are joined with them by a shuffle.
BROADCAST_ROWS = 500_000
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
FILES = "path string, records long"
_RECORD = "origin string, number int, total long, kind string, page_id long, refers_to long, digest string, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[a : a + size]), body[a : a + size]) for a in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """Decode chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        out.append(data[at : at + size])
        if len(out[-1]) != size or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def records(source: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of every record of a gzip-per-record file, read by windows."""
    fed = source.read(WINDOW_BYTES)
    while fed:
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            if not fed:
                raise ValueError("a record is cut short")
            parts.append(reader.decompress(fed))
            fed = reader.unused_data if reader.eof else source.read(WINDOW_BYTES)
        fed = fed or source.read(WINDOW_BYTES)
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        if not lines[0].startswith("WARC/") or len(rest) != size + 4:
            raise ValueError("no whole WARC record")
        yield fields, rest[:size]


def record_id(page_id: int | None, row: str) -> str:
    """Identifier of a page's record: all rows of a response's page_id and payload share a digest, so a revisit can name its first."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{row}>"


def _page_records(page_id: int | None, row: str, url: str | None, payload: bytes, first: tuple[int, str] | None, segment_bytes: int) -> Iterator[bytes]:
    """The record of a page and its continuations; first is the page_id and the row of the response that a revisit names."""
    name = record_id(page_id, row)
    target = " ".join((url or "about:blank").split())
    digest = "sha1:" + base32_sha1(payload)
    common_fields = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("WARC-Page-ID", page_id), ("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record([("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(*first)), *common_fields], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *common_fields, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = len(block) if k == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last)], part)


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with __row, a key of its own, and __first, page_id and key of the response where this is a revisit.

    Payloads stay where they are: only digests are counted, and only the revisits' keys come back to the pages.
    """
    keyed = common.stored(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), common.text_bytes("html").alias("payload")).withColumn("__row", F.monotonically_increasing_id()), "warc-pages")
    digests = common.stored(keyed.filter(F.col("page_id").isNotNull() & (F.length("payload") >= least_bytes)).select("__row", "page_id", F.unhex(F.sha2("payload", 256)).alias("__sha")), "warc-digests")
    # stored, so that Spark splits the join at a frequent payload
    first = common.stored(digests.groupBy("__sha").agg(F.min(F.struct("page_id", "__row")).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n"), "warc-first")
    again = common.stored(digests.join(first, "__sha").filter(F.col("page_id") > F.col("__first.page_id")).select("__row", "__first"), "warc-again")
    if again.count() <= BROADCAST_ROWS:  # three longs a row
        again = F.broadcast(again)
    return keyed.join(again, "__row", "left")


def write_pages(pages: DataFrame, folder: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write pages (page_id, url, html; other columns are left out) under folder; return the stored list of files.

    A null html is an empty payload. Of rows that share page_id and payload, all are responses if their page_id is the
    least; a null page_id is always a response. Payloads below least_bytes are all responses. An empty table writes no
    file. A task writes under a name of its own attempt and renames at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        number = task.partitionId()
        names = [f"pages-{number:06d}.warc.gz", f"pages-{number:06d}-more.warc.gz"]
        own = [f"{root}/.{n}-{task.taskAttemptId()}" for n in names]
        counts = [0, 0]
        with where.open_output_stream(own[0], compression=None) as a, where.open_output_stream(own[1], compression=None) as b:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "__row", "url", "__first")]
                for page_id, row, url, first, payload in zip(*columns, binary_list(batch.column("payload")), strict=True):
                    for k, record in enumerate(_page_records(page_id, str(row), url, payload, first and (first["page_id"], str(first["__row"])), segment_bytes)):
                        (b if k else a).write(record)
                        counts[k > 0] += 1
        for temporary, name in zip(own, names, strict=True):
            where.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{n}" for n, c in zip(names, counts, strict=True) if c], "records": [c for c in counts if c]})

    return common.stored(with_first(pages, least_bytes).mapInArrow(run, FILES), "warc-files")


def read_records(files: DataFrame) -> DataFrame:
    """Every record of the files (column path), blocks as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                source = where.open_input_stream(name, compression=None, buffer_size=1 << 20)
                for f, block in records(source):
                    page = f.get("warc-page-id")
                    refers = f.get("warc-refers-to")
                    rows.append({"origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "number": int(f.get("warc-segment-number", 0)), "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "kind": f["warc-type"], "page_id": int(page) if page else None, "refers_to": int(refers.split(":")[2]) if refers else None, "digest": f.get("warc-payload-digest"), "block": block})
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                source.close()
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(run, _RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """Records whole: divided ones are grouped by origin, ordered by segment number and held against their total length."""
    whole = found.filter("number = 0").select("kind", "page_id", "refers_to", "digest", "block")
    parts = found.filter("number > 0").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("s"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("kind", "page_id", "refers_to", "digest")],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, segments, total in zip(*[batch.column(c).to_pylist() for c in ("origin", "s", "total")], strict=True):
                block = b"".join(x["block"] for x in segments)
                if [x["number"] for x in segments] != list(range(1, len(segments) + 1)) or total != len(block):
                    raise ValueError(f"segments are missing of {origin}")
                out.append(block)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "page_id", "refers_to", "digest")], pa.array(out, pa.binary())], ["kind", "page_id", "refers_to", "digest", "block"])

    return whole.unionByName(parts.mapInArrow(run, "kind string, page_id long, refers_to long, digest string, block binary"))


def read_pages(files: DataFrame) -> DataFrame:
    """One row a page out of the files: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    Digests of responses are taken from the payload read back and must equal those stored; a revisit has a null
    payload, and its full payload's length and digest from its own record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, payloads = [], [], []
            for kind, stored, block in zip(*[batch.column(c).to_pylist() for c in ("kind", "digest", "block")], strict=True):
                head, _, body = block.partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
                digest = stored.removeprefix("sha1:")
                if kind == "revisit":
                    sizes.append(int(fields[b"content-length"]))
                    payloads.append(None)
                else:
                    payload = unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                    if base32_sha1(payload) != digest:
                        raise ValueError("a payload does not have its digest")
                    sizes.append(len(payload))
                    payloads.append(payload)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column("kind"), batch.column("refers_to"), pa.array(payloads, pa.binary())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return reassemble(read_records(files)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_pages(common.table(spark, sf_dir, "pages"), common.fresh_dir(spark, "warc"))
    return read_pages(files).drop("payload")
