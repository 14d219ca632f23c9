"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library's own trainer. The ordinary one is trained on the words that most
ordinary texts use; the toxic one on the same and on word beginnings that toxic texts use significantly more often than
ordinary ones, each text counted once and near copies of a text not at all. Bytes are moved by their place in their
word first, so that strings match at the same place of a word alone. The trainer runs in rounds: what the last
rounds' dictionaries do not hold is trained on again. Every window of a text is compressed with both. What both hold
costs the same, so a shorter length under the toxic dictionary tells of toxic strings. The numbers of windows beyond
several margins, and the length of the text, go through a logistic calibration, fitted on labelled texts that the
dictionaries of their fold have not seen; the final dictionaries are trained on all folds.

Fitting takes a bounded sample of labelled rows (SAMPLE_ROWS of each label, SAMPLE_BYTES of text at most) to the
driver. Scoring is one pass over all documents without a shuffle. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm import common
from tidemark.llm.spans import _MASK, binary_list

SAMPLE_ROWS = {1: 1500, 0: 3000}
SAMPLE_BYTES = 24 << 20
FOLDS = 5
WINDOW, STEP = 48, 36
#: Every window follows these bytes, which both dictionaries end with. So every window is stored as compressed, and
#: its length follows its content by single bytes.
LEAD = bytes(range(1, 25))
MARGINS = (1, 2, 3, 4, 5, 6, 8)
THRESHOLD = 0.3
DICTIONARY_BYTES = 8192
ORDINARY_WORDS = 40
#: Bytes of a word beginning with the space before it; the first that tells is taken, from ENOUGH bytes on.
SHORTEST, LONGEST, ENOUGH = 5, 10, 8
LEAST_TEXTS, RATIO = 4, 8.0
_MATCH = 6
_BITS = 24

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _bucket(x: np.ndarray, bits: int = _BITS) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * _A
        return ((x ^ (x >> np.uint64(32))) * _B) >> np.uint64(64 - bits)


def _folded(text: bytes) -> bytes:
    return b" " + text.translate(_FOLD) + b" "


def _placed(folded: bytes) -> bytes:
    """Every byte of a word moved by its place in it: strings match only where they stand at the same place of a word."""
    data = np.frombuffer(folded, np.uint8)
    at = np.arange(len(data))
    place = at - np.maximum.accumulate(np.where(data == 32, at, 0))
    return (data + (place * 37).astype(np.uint8)).tobytes()


def _eight(text: bytes) -> np.ndarray:
    """Eight bytes from each place, zeros behind the end."""
    data = np.frombuffer(text + bytes(16), np.uint8)
    return np.ndarray((len(text) + 8,), "<u8", data.data, strides=(1,))


def _novel(texts: list[bytes]) -> list[bytes]:
    """Texts of which at least half of the fourteen-byte strings stand in no text before: near copies count once."""
    seen, out = np.zeros(1 << 26, bool), []
    for text in texts:
        e = _eight(text)
        with np.errstate(over="ignore"):
            h = np.unique(_bucket(_bucket(e[: len(text)], 64) + e[6 : len(text) + 6], 26))
        if len(h) and seen[h].mean() < 0.5:
            seen[h] = True
            out.append(text)
    return out


class _Beginnings:
    """Word beginnings of a text: where each word starts, and buckets of its first bytes by their number."""

    def __init__(self, text: bytes):
        data, e = np.frombuffer(text, np.uint8), _eight(text)
        space = data == 32
        self.start = np.flatnonzero(space[:-1] & ~space[1:])
        ends = np.append(np.flatnonzero(space), len(text))
        room = ends[np.searchsorted(ends, self.start + 1)] + 1 - self.start  # with the space behind the word
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(SHORTEST, LONGEST + 1):
            word = np.flatnonzero(room >= n)
            at = self.start[word]
            with np.errstate(over="ignore"):
                x = (e[at] & _MASK[min(n, 8)]) * _B + (e[at + 8] & _MASK[max(0, n - 8)]) + np.uint64(n)
            self.of[n] = word.astype(np.int32), _bucket(x).astype(np.int32)
        self.all = np.unique(np.concatenate([h for _, h in self.of.values()]))


def _counted(texts: list[_Beginnings]) -> np.ndarray:
    out = np.zeros(1 << _BITS, np.int32)
    for t in texts:
        out[t.all] += 1
    return out


def _evidence(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Log likelihood ratio of x of x + y texts being toxic against the share of toxic texts, where x is above it."""
    n = np.maximum(x + y, 1)
    p = x / n
    ratio = x * np.log(np.where(x > 0, p, 1) / share) + y * np.log(np.where(y > 0, 1 - p, 1) / (1 - share))
    return np.where(p > share, ratio, 0.0)


def _telling(texts: list[bytes], parts: list[_Beginnings], toxic: np.ndarray, ordinary: np.ndarray, n_ordinary: int) -> list[bytes]:
    """Beginnings that toxic texts have RATIO times as often, beyond what chance gives among so many; repeated ones up to eight times."""
    if not texts or not n_ordinary:
        return []
    share = len(texts) / (len(texts) + n_ordinary)
    needed = np.log(max(1, int((toxic >= LEAST_TEXTS).sum()))) - 1
    out: Counter = Counter()
    for text, part in zip(texts, parts, strict=True):
        best = np.zeros(len(part.start), np.int64)
        for n, (word, h) in part.of.items():
            x, y = toxic[h].astype(float), ordinary[h].astype(float)
            odds = (x / max(1, len(texts))) / ((y + 0.5) / max(1, n_ordinary))
            tells = (x >= LEAST_TEXTS) & (odds >= RATIO) & (_evidence(x, y, share) >= needed) & (best[word] < ENOUGH)
            best[word[tells]] = n
        text = _placed(text)
        out.update(text[a : a + n] for a, n in zip(part.start[best > 0].tolist(), best[best > 0].tolist(), strict=True))
    return [s for s, n in sorted(out.items()) for _ in range(min(n, 8))]


def _trained(strings: list[bytes], limit: int) -> bytes:
    """Dictionaries by the zstandard trainer in rounds, each over the strings that those before don't hold, the last in front."""
    import zstandard as z

    left, out, number, idle = strings, b"", 0, 0
    while left and idle < 3:
        number += 1
        mixed = sorted(left, key=lambda s: (zlib.crc32(s, number), s))  # another order each round: it cuts strings at its segments
        samples = [b"\0" + s for s in mixed] * -(-64 // len(left))  # the trainer wants many; zeros are in no text
        try:
            more = z.train_dictionary(min(limit, 4096), samples, k=24, d=6, f=18, accel=1).as_bytes()
        except z.ZstdError:  # it finds nothing that repeats
            break
        rest = [s for s in left if s not in more]
        if len(out) + len(more) > limit:
            break
        if len(rest) == len(left):
            idle += 1
        else:
            left, out, idle = rest, more + out, 0
    return out


def _dictionaries(toxic: list[tuple[bytes, _Beginnings]], ordinary: list[tuple[bytes, _Beginnings]]) -> tuple[bytes, bytes]:
    (texts, parts), (others, other_parts) = ([list(c) for c in zip(*x, strict=True)] or [[], []] for x in (toxic, ordinary))
    used: Counter = Counter()
    for text in others:
        used.update(set(text.split(b" ")))
    words = sorted((w for w in used if len(w) > 3), key=lambda w: (-used[w], w))[:ORDINARY_WORDS]
    plain = _trained([_placed(b" " + w + b" ") for w in words for _ in range(2)], DICTIONARY_BYTES)
    return _trained(_telling(texts, parts, _counted(parts), _counted(other_parts), len(others)), DICTIONARY_BYTES) + plain, plain


def _windows(text: bytes) -> np.ndarray:
    """Windows of a text, one a row behind LEAD; the last ones are filled with spaces."""
    body = _placed(_folded(text))
    n = max(1, -(-max(0, len(body) - WINDOW) // STEP) + 1)
    data = np.frombuffer(body.ljust((n - 1) * STEP + WINDOW, b" "), np.uint8)
    rows = np.lib.stride_tricks.as_strided(data, (n, WINDOW), (STEP, 1))
    return np.concatenate((np.broadcast_to(np.frombuffer(LEAD, np.uint8), (n, len(LEAD))), rows), axis=1)


class Compressor:
    def __init__(self, content: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters(window_log=15, hash_log=13, chain_log=13, search_log=4, min_match=_MATCH, target_length=32, strategy=z.STRATEGY_GREEDY, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        dictionary = z.ZstdCompressionDict(content + LEAD, dict_type=z.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        self.inner = z.ZstdCompressor(dict_data=dictionary, compression_params=params)

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        import zstandard as z

        n, width = rows.shape
        at = np.empty((n, 2), "<u8")
        at[:, 0], at[:, 1] = np.arange(n) * width, width
        out = self.inner.multi_compress_to_buffer(z.BufferWithSegments(rows.tobytes(), at.tobytes()), threads=1)
        return np.fromiter((len(out[k]) for k in range(n)), np.int64, n)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    bias: float

    def features(self, texts: list[bytes]) -> np.ndarray:
        toxic, ordinary = Compressor(self.toxic), Compressor(self.ordinary)
        out = np.zeros((len(texts), len(MARGINS) + 1))
        rows: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            block, who = np.concatenate(rows), np.concatenate(owner)
            gain = ordinary.lengths(block) - toxic.lengths(block)
            for k, margin in enumerate(MARGINS):
                out[:, k] += np.bincount(who[gain >= margin], minlength=len(texts))

        for i, text in enumerate(texts):
            windows = _windows(text)
            out[i, -1] = len(windows)
            for a in range(0, len(windows), 16384):
                rows.append(windows[a : a + 16384])
                owner.append(np.full(len(rows[-1]), i))
                held += len(rows[-1])
                if held >= 16384:
                    flush()
                    rows, owner, held = [], [], 0
        if held:
            flush()
        return np.log1p(out)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.features(texts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.02, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on the weights."""
    design = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(design.shape[1])
    ridge = np.diag([l2 * len(x)] * x.shape[1] + [1e-6]) / max(1, x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def sample(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """Labelled texts, so many of each label, chosen by a hash of doc_id, distinct and in a fixed order; all labels' counts.

    One text a doc_id: of several rows the one with the least text hash. SAMPLE_BYTES holds before any text leaves Spark.
    """
    rows = rows or SAMPLE_ROWS
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    picked = None
    for y, n in rows.items():
        part = own.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    text = common.text_bytes()
    found = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("th")).join(F.broadcast(picked), "id")
    found = common.stored(found.select(F.xxhash64("id").alias("h"), "id", "y", "th", F.length("t").alias("n"), "t"), "labelled")
    once = found.groupBy("h", "id", "y").agg(F.min_by("n", "th").alias("n"), F.min("th").alias("th")).groupBy("th").agg(F.min_by(F.struct("h", "id", "n"), F.struct("h", "id")).alias("r")).select("r.*", "th")
    # at most as many rows as sum(rows); texts stay where they are. One that doesn't fit is passed over, those behind it are not
    room, fits = SAMPLE_BYTES, []
    for r in sorted(once.select("h", "id", "th", "n").collect(), key=lambda r: (r.h, r.id)):
        if r.n <= room:
            room -= r.n
            fits.append((r.h, r.id, r.th))
    fits = docs.sparkSession.createDataFrame(fits, "h long, id long, th long")
    got = found.join(F.broadcast(fits), ["h", "id", "th"]).select("h", "y", "t").dropDuplicates(["h"]).collect()
    common.forget(docs.sparkSession, found)
    pairs = [(bytes(r.t), r.y) for r in sorted(got, key=lambda r: r.h)]
    return pairs, {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}


def fit(pairs: list[tuple[bytes, int]], counts: dict[int, int]) -> Model:
    """Dictionaries from all labelled texts, the calibration from folds held out in turn; without both labels, a flat model.

    counts of all labels turn the calibration from the sample's share of toxic texts to the true one.
    """
    sides = {v: [(t, _Beginnings(t)) for t in _novel([_folded(t) for t, y in pairs if y == v])] for v in (1, 0)}
    model = Model(*_dictionaries(sides[1], sides[0]), np.zeros(len(MARGINS) + 1), 0.0)
    true = np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    if min(map(len, sides.values())) < FOLDS:
        model.bias = float(true)
        return model
    x, y = [], []
    for fold in range(FOLDS):
        learned = {v: [t for k, t in enumerate(side) if k % FOLDS != fold] for v, side in sides.items()}
        rest = [(t, v) for v, side in sides.items() for t, _ in side[fold::FOLDS]]
        x.append(Model(*_dictionaries(learned[1], learned[0]), model.weights, 0.0).features([t for t, _ in rest]))
        y += [v for _, v in rest]
    y = np.array(y, float)
    model.weights, model.bias = _logistic(np.concatenate(x), y)
    model.bias += float(true - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score added, 0 to 1.

    Other columns stay; a column named score is replaced. Null, empty and blank texts are one window of spaces. Texts of
    any length count with all their windows. Equal texts score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(shared.value.scores(binary_list(batch.column("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, "score"])

    return common.mapped(kept, run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))


def held_out() -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*sample(docs, labels.filter(~held_out())))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), trained(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
