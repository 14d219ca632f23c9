"""Hard-negative mining: integer inner products, filtered by product quantisation with a stored residual norm.

Every vector x is cut into sub-vectors of width components; each is stored as the number of its nearest centroid, with the
norm r of what all centroids together miss. For an anchor q one table holds the product of each of its sub-vectors with
each centroid, so a row's approximate score is a sum of table look-ups, and by Cauchy-Schwarz the true score lies within
|q| * r of it. A row whose upper bound stays below the best lower bounds is out for certain; the true integer scores of all
others are computed. Codebooks only decide how much is filtered, never what is returned; they are fitted on SAMPLE rows.

Anchors are a stated query set. Encoded rows lie in files of the shared folder, sorted by label inside batches. A task holds one block of
anchors and streams one range of the files (at most RANGE_ROWS rows), keeping the best few of each anchor; ranges are
merged by a window over at most a few rows an anchor and range. Memory is bounded by the block and batch sizes, and a lost
task only reads its files again. The work is anchors x rows, as the query set demands; no pair is emitted but results of ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

WIDTH = 2
CENTROIDS = 256
#: Rows that codebooks are fitted on: those of least hash.
SAMPLE = 4096
ROUNDS = 6
ANCHORS = 1024
BATCH_ROWS = 16_384
RANGE_ROWS = 4 << 20
#: Pairs of an anchor and a row whose arrays a task holds at once.
PAIRS = 1 << 21
#: Components beyond this are out of reach of 64-bit scores.
_REACH = 1 << 62
_LOW = -(1 << 62)


def codebooks(sample: np.ndarray, width: int = WIDTH, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """(sub-vectors, centroids, width) integers: k-means on each slice of the sample, or its distinct values where they are few."""
    parts = sample.shape[1] // width
    books = np.zeros((parts, centroids, width), np.int64)
    for s in range(parts):
        points = sample[:, s * width : (s + 1) * width].astype(np.float64)
        distinct = np.unique(points, axis=0)
        if len(distinct) <= centroids:
            books[s, : len(distinct)] = distinct
            continue
        mid = distinct[np.linspace(0, len(distinct) - 1, centroids).astype(int)]
        for _ in range(rounds):
            near = _nearest(points, mid)
            n = np.bincount(near, minlength=centroids)
            sums = np.stack([np.bincount(near, points[:, k], centroids) for k in range(width)], axis=1)
            mid = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], mid)
        books[s] = np.rint(mid)
    return books


def _nearest(points: np.ndarray, mid: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for a in range(0, len(points), 8192):
        out[a : a + 8192] = (points[a : a + 8192] @ (-2.0 * mid.T) + (mid * mid).sum(axis=1)).argmin(axis=1)
    return out


def encode(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (sub-vectors, rows), and the norm of what they miss, rounded up."""
    parts, _, width = books.shape
    codes = np.empty((parts, len(vectors)), np.int16)
    missed = np.zeros(len(vectors), np.float64)
    for s in range(parts):
        own = vectors[:, s * width : (s + 1) * width]
        codes[s] = _nearest(own.astype(np.float64), books[s].astype(np.float64))
        rest = (own - books[s][codes[s]]).astype(np.float64)
        missed += (rest * rest).sum(axis=1)
    return codes, np.nextafter(np.sqrt(missed) * (1 + 1e-12), np.inf)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, filled up with zeros to width."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    flat, lengths = flat[ends[0] : ends[-1]], np.diff(ends)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return out


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, and whether they are null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def vectors_of(rows: DataFrame, vector: str, label: str, relabel: bool) -> DataFrame:
    """key, vec_id, label, q: rows with a label and a vector of finite components; q holds floor(256 * x)."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    number = F.col(label).cast("long")
    moved = F.when((F.col("vec_id") % 7 == 0) & F.lit(relabel), (number + 1) % 10).otherwise(number)
    taken = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & sound)
    return taken.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * 256)).alias("q"))


class _Shape:
    """What the driver knows of the table: a few numbers and the codebooks."""

    def __init__(self, vectors: DataFrame):
        size, most = F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))
        self.rows, width, top = vectors.agg(F.count("*"), size, most).first()
        self.width = -(-max(width or 0, 1) // WIDTH) * WIDTH
        if self.width * (top or 0) ** 2 >= _REACH:
            raise ValueError(f"inner products of {self.width} components up to {top} (256 times the table's) leave 64 bits")
        self.exact = np.float64 if self.width * (top or 0) ** 2 < 1 << 53 else np.int64
        picked = vectors.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("q").toArrow().column("q").combine_chunks()
        picked = picked if isinstance(picked, pa.Array) else pa.array([], pa.list_(pa.int64()))
        self.books = codebooks(_matrix(picked, self.width)) if len(picked) else np.zeros((self.width // WIDTH, CENTROIDS, WIDTH), np.int64)


def _encoded_files(vectors: DataFrame, shape: _Shape) -> list[tuple[str, int]]:
    """(path, rows) of Arrow files of encoded rows; the driver sees these alone."""
    spark = vectors.sparkSession
    folder, width, books = common.fresh_dir(spark, "encoded"), shape.width, shape.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        held, n, total, out = [], 0, 0, None
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().taskAttemptId()}"

        def write() -> None:
            nonlocal held, n, out
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            q, (ids, none) = _matrix(table.column("q"), width), _numbers(table.column("vec_id"))
            labels, keys = _numbers(table.column("label"))[0], _numbers(table.column("key"))[0]
            order = np.lexsort((keys, ids, labels))
            codes, missed = encode(q[order], books)
            small = np.int16 if len(q) and np.abs(q).max() < 1 << 15 else np.int64
            batch = {
                "key": keys[order], "vec_id": ids[order], "none": none[order], "label": labels[order], "missed": missed,
                "codes": [codes.tobytes()] + [None] * (len(q) - 1), "q": [q[order].astype(small).tobytes()] + [None] * (len(q) - 1), "small": [small is np.int16] * len(q),
            }
            columns = [pa.array(v, pa.large_binary() if k in ("codes", "q") else None) for k, v in batch.items()]
            made = pa.RecordBatch.from_arrays(columns, list(batch))
            out = out or pa.ipc.new_file(where.open_output_stream(f"{root}/{name}", compression=None), made.schema)
            out.write_batch(made)
            held, n = [], 0

        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                held.append(batch.slice(a, BATCH_ROWS))
                n += held[-1].num_rows
                total += held[-1].num_rows
                if n >= BATCH_ROWS:
                    write()
        if n:
            write()
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "rows": pa.array([total], pa.int64())})

    files = max(-(-shape.rows // (1 << 18)), min(-(-shape.rows // BATCH_ROWS), spark.sparkContext.defaultParallelism), 1)
    return sorted((r.path, r.rows) for r in vectors.repartition(files).mapInArrow(run, "path string, rows long").collect())


class _Rows:
    """One batch of encoded rows."""

    def __init__(self, batch: pa.RecordBatch, width: int, exact: type):
        self.key, self.vec_id, self.label = (batch.column(c).to_numpy() for c in ("key", "vec_id", "label"))
        self.none, self.missed = batch.column("none").to_numpy(zero_copy_only=False), batch.column("missed").to_numpy()
        small = batch.column("small")[0].as_py()
        self.codes = np.frombuffer(batch.column("codes")[0].as_buffer(), np.int16).reshape(width // WIDTH, -1)
        self.q = np.frombuffer(batch.column("q")[0].as_buffer(), np.int16 if small else np.int64).reshape(-1, width).astype(exact)


def _batches(files: list[str], width: int, exact: type) -> Iterator[_Rows]:
    from pyarrow import fs

    for path in files:
        where, name = fs.FileSystem.from_uri(path)
        with where.open_input_file(name) as source:
            reader = pa.ipc.open_file(source)
            for k in range(reader.num_record_batches):
                yield _Rows(reader.get_batch(k), width, exact)


class _Anchors:
    """Anchors of one label with their tables of sub-vector times centroid."""

    def __init__(self, q: np.ndarray, books: np.ndarray, exact: type):
        parts, _, width = books.shape
        self.q = q.astype(exact)
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
        self.tables = np.einsum("asw,scw->sac", q.reshape(len(q), parts, width).astype(exact), books.astype(exact))

    def bounds(self, rows: _Rows, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Sure lower and upper bounds of all scores, (anchors, rows)."""
        score = np.zeros((len(self.q), at.stop - at.start), self.tables.dtype)
        for table, code in zip(self.tables, rows.codes[:, at], strict=True):
            score += table.take(code, axis=1)
        slack = np.ceil(self.norm[:, None] * rows.missed[None, at] * (1 + 1e-9)).astype(self.tables.dtype)
        return score - slack, score + slack

    def scores(self, rows: _Rows, at: slice, anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
        """True scores of the pairs: by one matrix product where most columns are asked for, else pair by pair."""
        if len(anchor) * 8 > len(self.q) * (at.stop - at.start):
            return (self.q @ rows.q[at].T)[anchor, row].astype(np.int64)
        out = np.empty(len(anchor), np.int64)
        for a in range(0, len(anchor), 1 << 16):
            both = slice(a, a + (1 << 16))
            out[both] = np.einsum("pw,pw->p", self.q[anchor[both]], rows.q[row[both] + at.start])
        return out


class _Best:
    """The first few of each group by descending score, then id (null last), then key."""

    def __init__(self, groups: int, keep: int):
        self.keep = keep
        self.found = [np.zeros(0, np.int64) for _ in range(5)]
        #: the score that a newcomer has to reach
        self.limit = np.full(groups, _LOW, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, none: np.ndarray, vec_id: np.ndarray, key: np.ndarray) -> None:
        both = [np.concatenate(x) for x in zip(self.found, (group, score, none.astype(np.int64), vec_id, key), strict=True)]
        order = np.lexsort((both[4], both[3], both[2], -both[1], both[0]))
        group = both[0][order]
        first = np.searchsorted(group, group)
        rank = np.arange(len(group)) - first
        kept = order[rank < self.keep]
        self.found = [x[kept] for x in both]
        full = rank == self.keep - 1
        self.limit[group[full]] = both[1][order[full]]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or nothing's score where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), _LOW, np.int64)
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k].astype(np.int64)


def _positives(anchors: dict[str, np.ndarray], files: list[str], shape: _Shape, keep: int, _: int) -> dict[str, np.ndarray]:
    """The first rows of every anchor's own label."""
    best, groups = _Best(len(anchors["key"]), keep), {}
    for label in np.unique(anchors["label"]):
        own = np.flatnonzero(anchors["label"] == label)
        groups[int(label)] = [(part, _Anchors(anchors["q"][part], shape.books, shape.exact)) for part in np.array_split(own, -(-len(own) * BATCH_ROWS // PAIRS))]
    for rows in _batches(files, shape.width, shape.exact):
        for label, parts in groups.items():
            at = slice(*np.searchsorted(rows.label, [label, label + 1]).tolist())
            for own, quantised in parts if at.stop > at.start else ():
                low, high = quantised.bounds(rows, at)
                other = rows.key[None, at] != anchors["key"][own, None]
                limit = np.maximum(_kth(np.where(other, low, _LOW), keep), best.limit[own])
                anchor, row = np.nonzero(other & (high >= limit[:, None]))
                score, place = quantised.scores(rows, at, anchor, row), row + at.start
                near = score >= limit[anchor]
                best.add(own[anchor[near]], score[near], rows.none[place[near]], rows.vec_id[place[near]], rows.key[place[near]])
    group, score, none, vec_id, key = best.found
    return {"anchor": anchors["key"][group], "place": np.zeros(len(group), np.int64), "score": score, "none": none, "vec_id": vec_id, "key": key}


def _negatives(anchors: dict[str, np.ndarray], files: list[str], shape: _Shape, places: int, keep: int) -> dict[str, np.ndarray]:
    """For every anchor and positive the first rows of other labels whose score is from half of the positive's to 95 % of it."""
    n, positive = len(anchors["key"]), anchors["scores"]
    least = np.where(anchors["known"], (positive + 1) // 2, 1)
    most = np.where(anchors["known"], _share(positive), 0)  # an unknown positive has an empty window
    best = _Best(n * places, keep)
    parts = [(own, _Anchors(anchors["q"][own], shape.books, shape.exact)) for own in np.array_split(np.arange(n), -(-n * BATCH_ROWS // PAIRS))]
    for rows in _batches(files, shape.width, shape.exact):
        at = slice(0, len(rows.key))
        for own, quantised in parts:
            low, high = quantised.bounds(rows, at)
            other = rows.label[None, :] != anchors["label"][own, None]
            wanted, limits = np.zeros(low.shape, bool), []
            for j in range(places):
                a, b = least[own, j, None], most[own, j, None]
                sure = other & (low >= a) & (high <= b)
                limit = np.maximum(np.maximum(_kth(np.where(sure, low, _LOW), keep), best.limit[own * places + j]), least[own, j])
                wanted |= other & (high >= limit[:, None]) & (low <= b) & (a <= b)
                limits.append(limit)
            anchor, row = np.nonzero(wanted)
            score = quantised.scores(rows, at, anchor, row)
            for j in range(places):
                fits = (score >= limits[j][anchor]) & (score <= most[own[anchor], j])
                best.add(own[anchor[fits]] * places + j, score[fits], rows.none[row[fits]], rows.vec_id[row[fits]], rows.key[row[fits]])
    group, score, none, vec_id, key = best.found
    return {"anchor": anchors["key"][group // places], "place": group % places, "score": score, "none": none, "vec_id": vec_id, "key": key}


def _share(score: np.ndarray) -> np.ndarray:
    """floor(95 * score / 100) without leaving 64 bits."""
    return score // 100 * 95 + score % 100 * 95 // 100


_FOUND = "anchor long, place long, score long, none long, vec_id long, key long"
_SEARCH = Callable[[dict[str, np.ndarray], list[str], _Shape, int, int], dict[str, np.ndarray]]


def _searched(anchors: DataFrame, files: list[tuple[str, int]], shape: _Shape, search: _SEARCH, places: int, keep: int) -> DataFrame:
    """Rows of search for blocks of anchors against ranges of the files; ranges of one block aren't merged yet.

    anchors: key, label, q and scores, a list of at most places scores.
    """
    spark, width = anchors.sparkSession, shape.width
    n = anchors.count()
    n_blocks = max(-(-n // ANCHORS), 1)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for b in held:
                    out.write_batch(b)
            yield pa.RecordBatch.from_pydict({"block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    n_ranges = min(len(files), max(-(-shape.rows // RANGE_ROWS), -(-2 * spark.sparkContext.defaultParallelism // n_blocks)))
    ranges = [[p for p, _ in files[k::n_ranges]] for k in range(n_ranges)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, k in zip(batch.column("block"), batch.column("range").to_pylist(), strict=True):
                table = pa.ipc.open_stream(own.as_buffer()).read_all().combine_chunks()
                one = lambda c: table.column(c).chunk(0)  # noqa: E731, B023
                scores = one("scores")
                known = np.arange(places)[None, :] < np.diff(scores.offsets.to_numpy())[:, None]
                found = search({"key": _numbers(one("key"))[0], "label": _numbers(one("label"))[0], "q": _matrix(one("q"), width), "scores": _matrix(scores, places), "known": known}, ranges[k], shape, places, keep)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in found.items()})

    blocks = anchors.repartition(n_blocks).mapInArrow(block, "block binary")
    cells = blocks.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(n_ranges - 1)))).repartition(n_blocks * n_ranges)
    return cells.mapInArrow(run, _FOUND)


def _firsts(found: DataFrame, by: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "none", "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, vector: str = "embedding", label: str = "label", relabel: bool = False, every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (see the contract of the query).

    rows needs vec_id, a label and a vector column; other columns pass by, whatever their names. relabel moves the labels of
    ids that 7 divides. Anchors are the rows whose vec_id every divides. A row with a null label, a null vector or a null or
    non-finite component takes no part; a null vec_id is never an anchor and comes last among ties. Repeated rows and ids are
    rows each for itself: a copy of an anchor may be its positive, a repeated anchor gives its rows again. A shorter vector
    counts as filled up with zeros; an empty one scores 0. A positive of negative score has no negatives, as its window is
    empty. Components so large that scores leave 64 bits are an error that says so. Ties go to the smaller vec_id. A table
    without rows or anchors gives no rows.
    """
    spark = rows.sparkSession
    vectors = common.stored(vectors_of(rows, vector, label, relabel), "vectors")
    shape = _Shape(vectors)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = vectors.filter(F.col("vec_id") % every == 0)
    if not shape.rows or not anchors.limit(1).count():
        return empty
    files = _encoded_files(vectors, shape)
    bare = anchors.select("key", "label", "q", F.array().cast("array<long>").alias("scores"))
    first = common.stored(_firsts(_searched(bare, files, shape, _positives, positives, 0), ["anchor"], positives), "positives")
    listed = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p")).select(F.col("anchor").alias("key"), F.col("p.score").alias("scores"))
    known = common.stored(anchors.select("key", "label", "q").join(listed, "key"), "anchors")
    found = _firsts(_searched(known, files, shape, _negatives, positives, negatives), ["anchor", "place"], negatives)
    pairs = first.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "none")
    ids = anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    null = lambda c: F.when(F.col("none") == 0, F.col(c))
    pairs = pairs.withColumn("positive_id", null("positive_id")).drop("none")
    out = found.withColumn("negative_id", null("vec_id")).join(pairs, ["anchor", "place"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.table(spark, sf_dir, "embeddings"), relabel=True)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""
