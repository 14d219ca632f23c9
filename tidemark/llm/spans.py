"""Vectorised work on many byte spans at once, for use inside Arrow batches.

A block of documents is one buffer; words, chunks and lines are (start, length) spans of it. Every function touches a
span eight bytes at a time for all spans together, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

PAD = 16
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def binary_list(column: pa.Array) -> list[bytes]:
    """Texts or blobs of an Arrow column as bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about limit bytes together; a longer text is a block of its own."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


class Block:
    """Several texts in one buffer, one separator byte after each."""

    def __init__(self, texts: list[bytes], separator: bytes = b" ", lower: bool = False):
        joined = separator.join(texts) + separator + b"\0" * PAD
        data = np.frombuffer(joined, np.uint8)
        self.size = len(joined) - PAD
        self.data = _LOWER[data] if lower else data
        self.raw = self.data.tobytes() if lower else joined
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else lengths
        self.ends = self.starts + lengths
        self._eight = np.ndarray((len(self.data) - 7,), "<u8", self.data.data, strides=(1,))

    def eight(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each offset, little-endian."""
        return self._eight[at]

    def hashes(self, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every span."""
        h = length.astype(np.uint64) * _C + np.uint64(seed)
        live, at, left = None, start, length
        with np.errstate(over="ignore"):
            while True:
                word = self._eight[at] & _MASK[np.minimum(left, 8)]
                x = (h if live is None else h[live]) ^ word
                x *= _A
                x ^= x >> np.uint64(29)
                x *= _B
                x ^= x >> np.uint64(32)
                if live is None:
                    h = x
                else:
                    h[live] = x
                more = np.flatnonzero(left > 8)
                if not len(more):
                    return h
                live = more if live is None else live[more]
                at, left = at[more] + 8, left[more] - 8

    def same(self, start: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the span at start equals the span of that length at other, byte for byte."""
        out = np.ones(len(start), bool)
        live, a, b, left = np.arange(len(start)), start, other, length
        while len(live):
            differ = ((self._eight[a] ^ self._eight[b]) & _MASK[np.minimum(left, 8)]) != 0
            out[live[differ]] = False
            more = np.flatnonzero((left > 8) & ~differ)
            live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
        return out

    def cut(self, start: int, length: int) -> bytes:
        return self.raw[start : start + length]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def distinct(block: Block, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each span, index of the first span of each code); spans of one code have equal bytes.

    Spans are grouped by a 64-bit hash and then compared with the first of their group; the rare rest gets codes of
    its own, so a collision costs time and never correctness.
    """
    codes, uniques = pd.factorize(block.hashes(start, length))
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    lead = first[codes]
    odd = np.flatnonzero((length != length[lead]) | ~block.same(start, start[lead], length))
    if len(odd):
        known: dict[tuple[int, bytes], int] = {}
        extra = []
        for i in odd.tolist():
            key = (int(codes[i]), block.cut(int(start[i]), int(length[i])))
            if key not in known:
                known[key] = len(first) + len(extra)
                extra.append(i)
            codes[i] = known[key]
        first = np.concatenate((first, np.array(extra, np.int64)))
    return codes, first


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of every span, one after another."""
    ends = np.cumsum(length)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(start - ends + length, length) + np.arange(int(ends[-1]))
