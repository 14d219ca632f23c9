"""Media columns: AVI files of motion-JPEG frames, one a row, written from and read back to bytes.

encode() turns payload bytes into greyscale frames: every 64 bytes are the 64 quantised coefficients of one 8 x 8 block,
so nothing is lost. Byte b becomes the coefficient b - 128, or b - 127 from 128 on; none is zero. The Huffman table gives
a value of s bits a code of 9 - s bits, so each coefficient takes 9 bits and each block 72 bytes; a restart marker
follows every block but the last. Those are plain baseline JPEG frames inside a RIFF AVI with an idx1 index.

decode() finds the frames through that index, reads the entropy-coded blocks of all frames of a batch together, and
builds luminance histograms from an inverse transform. A shot ends where the histogram difference exceeds the mean so
far by a margin of its deviation.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.spans import binary_list, blocks

SIDE = 32
BLOCKS = (SIDE // 8) ** 2
FRAME_BYTES = 64 * BLOCKS
RATE = 25
BINS = 16
MARGIN = 3.0
LEAST_DIFFERENCE = 0.25
BATCH_BYTES = 2 << 20
CLIPS = "array<struct<first_frame:int,frames:int,start_s:double,stop_s:double>>"


def _codes() -> np.ndarray:
    """The 9 bits of each byte: 8 - s ones and a zero, then the s bits of its coefficient."""
    out = np.zeros(256, np.uint16)
    for b in range(256):
        v = b - 128 if b < 128 else b - 127
        size = abs(v).bit_length()
        extra = v if v > 0 else v + (1 << size) - 1
        out[b] = (((1 << (8 - size)) - 1) << 1) << size | extra
    return out


_CODE = _codes()
_BYTE = np.full(512, -1, np.int16)
_BYTE[_CODE] = np.arange(256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header() -> bytes:
    lengths = bytes(1 if 1 <= n <= 8 else 0 for n in range(1, 17))
    values = bytes(range(8, 0, -1))  # the longest values have the shortest codes
    table = lambda kind: bytes([kind << 4]) + lengths + values
    return (
        b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
        + _segment(0xC4, table(0)) + _segment(0xC4, table(1)) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


_HEAD = _header()


def _pack_blocks(samples: np.ndarray) -> np.ndarray:
    """Bytes (n, 64) -> entropy-coded blocks (n, 72): eight 9-bit codes make nine bytes."""
    code = _CODE[samples].reshape(-1, 8)
    out = np.empty((len(code), 9), np.uint8)
    for k in range(9):
        high = code[:, k - 1] << (8 - k) if k else 0  # rest of the code before
        low = code[:, k] >> (k + 1) if k < 8 else 0
        out[:, k] = (high | low) & 0xFF
    return out.reshape(-1, 72)


def _unpack_blocks(coded: np.ndarray) -> np.ndarray:
    bits = coded.reshape(-1, 9).astype(np.uint16)
    code = np.empty((len(bits), 8), np.uint16)
    for k in range(8):
        code[:, k] = ((bits[:, k] << (k + 1)) | (bits[:, k + 1] >> (7 - k))) & 0x1FF
    found = _BYTE[code]
    if (found < 0).any():
        raise ValueError("a block holds a code that no coefficient has")
    return found.astype(np.uint8).reshape(-1, 64)


def _frame(coded: np.ndarray) -> bytes:
    parts = [row.tobytes().replace(b"\xff", b"\xff\0") for row in coded]
    out = [_HEAD]
    for k, part in enumerate(parts):
        out += [part, bytes([0xFF, 0xD0 + k % 8])] if k < len(parts) - 1 else [part, b"\xff\xd9"]
    return b"".join(out)


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], payload_bytes: int, text_bytes: int) -> bytes:
    """A RIFF AVI of JPEG frames; the INFO comment holds the two lengths."""
    longest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, longest * RATE, 0, 0x10, len(frames), 0, 1, longest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), longest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    info = _list(b"INFO", _chunk(b"ICMT", f"{payload_bytes} {text_bytes}".encode()))
    movie, index, at = [], [], 4
    for frame in frames:
        movie.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movie[-1])
    body = b"AVI " + head + info + _list(b"movi", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[list[bytes], int, int]:
    """(frames in the order of the index, payload bytes, text bytes)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movie = index = comment = None
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        inner = data[at + 8 : at + 12]
        if kind == b"LIST" and inner == b"movi":
            movie = at + 8
        elif kind == b"LIST" and inner == b"INFO":
            n = struct.unpack_from("<I", data, at + 16)[0]
            comment = data[at + 20 : at + 20 + n]
        elif kind == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movie is None or index is None or comment is None:
        raise ValueError("the AVI file lacks its frames, index or comment")
    frames = [data[movie + o + 8 : movie + o + 8 + n] for _, _, o, n in struct.iter_unpack("<4sIII", index)]
    payload, text = map(int, comment.split())
    return frames, payload, text


def _scan_data(frame: bytes) -> bytes:
    """Entropy-coded bytes of a frame without markers and stuffing; its tables must be the ones written here."""
    if not frame.startswith(_HEAD) or frame[-2:] != b"\xff\xd9":
        raise ValueError("no frame of this writer")
    body = np.frombuffer(frame, np.uint8)[len(_HEAD) : -2]
    after = np.zeros(len(body), bool)
    after[1:] = body[:-1] == 0xFF
    marker = np.zeros(len(body), bool)
    marker[:-1] = (body[:-1] == 0xFF) & (body[1:] != 0)
    return body[~(after | marker)].tobytes()  # drops stuffed zeros, and both bytes of markers


def payload_of(text: bytes) -> bytes:
    """text with bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def encode_texts(texts: list[bytes]) -> list[bytes]:
    payloads = [payload_of(t) for t in texts]
    framed = [p + bytes(-len(p) % FRAME_BYTES) for p in payloads]
    coded = _pack_blocks(np.frombuffer(b"".join(framed), np.uint8).reshape(-1, 64))
    out, at = [], 0
    for text, payload, whole in zip(texts, payloads, framed, strict=True):
        n = len(whole) // FRAME_BYTES
        out.append(write_avi([_frame(coded[at + k * BLOCKS : at + (k + 1) * BLOCKS]) for k in range(n)], len(payload), len(text)))
        at += n * BLOCKS
    return out


def _cosines() -> np.ndarray:
    """(64, 64): zigzag coefficients of a block to its samples."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[(p[0] + p[1] + 1) % 2]))
    return np.stack([np.outer(basis[:, i], basis[:, j]).ravel() for i, j in order]).astype(np.float32)


_COSINES = _cosines()


def _histograms(samples: np.ndarray) -> np.ndarray:
    """Luminance histograms of frames (n, FRAME_BYTES), each adding up to 1."""
    coefficient = samples.reshape(-1, 64).astype(np.float32)
    coefficient -= np.where(coefficient < 128, np.float32(128), np.float32(127))
    bins = np.clip((coefficient @ _COSINES + 128) * (BINS / 256), 0, BINS - 1).astype(np.int32).reshape(len(samples), -1)
    flat = np.bincount((bins + np.arange(len(samples))[:, None] * BINS).ravel(), minlength=BINS * len(samples))
    return flat.reshape(-1, BINS) / FRAME_BYTES


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frames) of each shot: a cut is a difference above the shot's mean so far by MARGIN deviations."""
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1).tolist()
    out, first, n, total, squares = [], 0, 0, 0.0, 0.0
    for k, x in enumerate(change, 1):
        mean = total / n if n else 0.0
        deviation = max(0.0, squares / n - mean * mean) ** 0.5 if n else 0.0
        if x > max(LEAST_DIFFERENCE, mean + MARGIN * deviation):
            out.append((first, k - first))
            first, n, total, squares = k, 0, 0.0, 0.0
        else:
            n, total, squares = n + 1, total + x, squares + x * x
    return [*out, (first, len(histograms) - first)]


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the text of each row as an AVI file; null counts as empty. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_list(batch.column("text"))
            for a, b in blocks(texts, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(encode_texts(texts[a:b]), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """One row a file: doc_id, payload and text lengths, digests of the payload read back and of the file, timed clips.

    media needs doc_id and media. A null file gives nulls but for doc_id; a file that is no AVI of this writer is an
    error. Equal files give equal rows; an empty table gives none.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "clips"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, clips " + CLIPS

    def rows(doc_ids: list, files: list[bytes]) -> pa.RecordBatch:
        read = [read_avi(f) for f in files]
        samples = _unpack_blocks(np.frombuffer(b"".join(_scan_data(x) for frames, _, _ in read for x in frames), np.uint8).reshape(-1, 72)).reshape(-1, FRAME_BYTES)
        histograms = _histograms(samples)
        flat, at, out = samples.tobytes(), 0, []
        for doc_id, data, (frames, size, text) in zip(doc_ids, files, read, strict=True):
            payload = flat[at * FRAME_BYTES : at * FRAME_BYTES + size]
            clips = [{"first_frame": a, "frames": n, "start_s": a / RATE, "stop_s": (a + n) / RATE} for a, n in shots(histograms[at : at + len(frames)])]
            out.append((doc_id, text, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), len(frames), clips))
            at += len(frames)
        return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema=arrow)

    clip = pa.struct([("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("stop_s", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(clip)]
    arrow = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, found = batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()
            missing = [d for d, f in zip(doc_ids, found, strict=True) if f is None]
            if missing:
                yield pa.RecordBatch.from_pylist([{"doc_id": d} for d in missing], schema=arrow)
            doc_ids, files = [d for d, f in zip(doc_ids, found, strict=True) if f is not None], [f for f in found if f is not None]
            for a, b in blocks(files, BATCH_BYTES):
                yield rows(doc_ids[a:b], files[a:b])

    return media.select(F.col("doc_id").cast("long"), F.col("media").cast("binary")).mapInArrow(run, schema)


def clip_rows(decoded: DataFrame) -> DataFrame:
    """One row a clip: doc_id, number, first frame, frames, start and stop in seconds."""
    return decoded.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def op6_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(common.table(spark, sf_dir, "documents")))
    shot = F.transform("clips", lambda c: F.concat_ws("+", c["first_frame"].cast("string"), c["frames"].cast("string")))
    feature = F.concat(F.lit("frames="), F.col("n_frames").cast("string"), F.lit(";shots="), F.array_join(shot, ","))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
