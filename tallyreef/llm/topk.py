"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments; each segment keeps its mean and deviation. For two
vectors the squared distance is at least the sum over segments of
``length * ((mean - mean')^2 + (deviation - deviation')^2)``, so the inner product,
half of ``|q|^2 + |c|^2 - distance^2``, is at most what that bound gives. Candidates
are passed through bounds of finer and finer segments against the k-th best score
so far, and only survivors are scored in full.

Vectors are first turned onto the main axes of the candidates at hand, which
changes no distance; the axes along which vectors differ most come first and have
segments of their own from the coarsest resolution on. How much the bounds leave
depends on the data: little where vectors lie in groups, nearly all where they
are spread evenly in all dimensions, as no bound of few numbers can tell these apart.

Rows are packed into blocks. A group of candidate blocks, of bounded size, is held
by one task, which reads all query blocks in turn and carries each query's bar
from one candidate block to the next; only k rows for each query leave it.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows without an id; vectors of other lengths are
compared among their own length only; every row is a query or candidate by itself,
so a query meets other rows of its own id, and each row of an id that repeats
among queries has its own ranks; ties go to the smaller id; a query with no
candidate has no rows; a score outside 64 bits stands as the nearest number that
they hold; an empty table gives no rows; extra columns are not read. There are no texts; a
very long vector makes its blocks hold fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreef.llm import common

SCALE, TOP, EVERY = 256, 5, 50
#: Axes with a segment of their own, and segments of all others, of each resolution, coarse to fine; the finest keeps fewer
#: numbers than a vector of 64 components has, so a bound is never the score itself.
RESOLUTIONS = ((8, 4), (16, 8), (24, 16))
#: Bytes of a block's values, rows of a candidate and of a query block, and bytes of the blocks that a task holds, at most.
BLOCK_BYTES, CANDIDATES, QUERIES, HELD_BYTES = 1 << 21, 4096, 1024, 1 << 26
#: Queries that are compared at once.
RUN = 64
#: Candidates of a task's first block, by coarse bound, whose scores set a query's first bar.
SEEDS = 32
#: Largest length for which main axes are sought; longer vectors keep their own.
MOST_AXES = 512
#: Inner products up to this are exact in double precision.
EXACT = 2.0**53
#: Share of survivors from which scoring all of a block at once costs less.
DENSE = 0.1
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def axes(x: np.ndarray) -> np.ndarray:
    """Orthogonal matrix that turns rows onto their main axes, longest first."""
    with np.errstate(all="ignore"):
        second = x.T @ x
    if x.shape[1] > MOST_AXES or not np.isfinite(second).all():
        return np.eye(x.shape[1])
    return np.linalg.eigh(second)[1][:, ::-1]


def _segments(x: np.ndarray, single: int, rest: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length: ``single`` of length 1, then ``rest`` of equal length."""
    dim = x.shape[1]
    single = min(single, dim)
    edges = single + np.linspace(0, dim - single, min(rest, dim - single) + 1).astype(int)
    if dim == single:
        return x[:, :single]
    lengths = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / lengths
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([x[:, :single], np.hstack([mean, deviation]) * np.sqrt(np.concatenate([lengths, lengths]))])


def _scores(q: np.ndarray, c: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of rows of q with rows of c, whose components are no larger than ``largest``, as exact integers."""
    if float(np.abs(q).max(initial=0)) * largest * q.shape[1] < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in x] for x in (q, c)]
    return np.array([[min(_MOST, max(_LEAST, sum(map(int.__mul__, a, b)))) for b in whole[1]] for a in whole[0]], np.int64).reshape(len(q), len(c))


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _joined(blocks: list[Block], size: int) -> Iterator[Block]:
    """Blocks (rows, ids, values) put together to ``size`` rows at least, but for the last."""
    held: list[Block] = []
    for block in blocks:
        held.append(block)
        if sum(len(x[0]) for x in held) >= size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


class Held:
    """Candidate blocks in memory, with their statistics."""

    def __init__(self, blocks: list[Block]):
        blocks = list(_joined(blocks, _rows_of(blocks[0][2].shape[1])))
        self.turn = axes(blocks[0][2])
        self.blocks = []
        for rows, ids, values in blocks:
            with np.errstate(all="ignore"):
                turned = values @ self.turn
                self.blocks.append((rows, ids, values, float(np.abs(values).max()), (values * values).sum(1), [_segments(turned, *r) for r in RESOLUTIONS]))
        #: Pairs that each bound left, and all.
        self.left, self.pairs = np.zeros(len(RESOLUTIONS), np.int64), 0

    def best(self, q_rows: np.ndarray, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and score of the best ``top`` candidates of each query."""
        with np.errstate(all="ignore"):
            square = (q * q).sum(1)
            levels = [_segments(q @ self.turn, *r) for r in RESOLUTIONS]
        found = []
        for at in range(0, len(q), RUN):
            part = slice(at, at + RUN)
            n = len(q[part])
            # The best so far of each query: scores fall, then ids rise; the bar is the last of them.
            places, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            bar = np.full(n, -np.inf)
            for rows, c_ids, values, largest, c_square, c_levels in self.blocks:
                own = q_rows[part][:, None] == rows
                exact = float(np.abs(q[part]).max()) * largest * q.shape[1] < EXACT
                first = (q[part], values, own, top) if exact and not np.isfinite(bar).any() else None
                i, j = self._survivors(square[part], [x[part] for x in levels], c_square, c_levels, bar, first)
                if len(i) > DENSE * n * len(values):
                    new = _scores(q[part], values, largest)[i, j]
                elif exact:
                    new = np.einsum("nd,nd->n", q[part][i], values[j]).astype(np.int64)
                else:
                    new = np.zeros(len(i), np.int64)
                    for k, (a, b) in enumerate(zip(np.searchsorted(i, range(n)), np.searchsorted(i, range(n), "right"), strict=True)):
                        if b > a:
                            new[a:b] = _scores(q[at + k : at + k + 1], values[j[a:b]], largest)[0]
                other = ~own[i, j]
                places, ids, scores = (np.concatenate(x) for x in ((places, i[other]), (ids, c_ids[j[other]]), (scores, new[other])))
                order = np.lexsort((ids, ~scores, places))  # ~ turns the order of all 64-bit numbers
                places, ids, scores = places[order], ids[order], scores[order]
                rank = np.arange(len(places)) - np.searchsorted(places, places)
                keep = rank < top
                last = rank == top - 1
                bar[places[last]] = np.nextafter(scores[last].astype(np.float64), -np.inf)
                places, ids, scores = places[keep], ids[keep], scores[keep]
            found.append((places + at, ids, scores))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _survivors(self, square: np.ndarray, levels: list[np.ndarray], c_square: np.ndarray, c_levels: list[np.ndarray], bar: np.ndarray, first: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate), by query, that no bound rules out; a bound without a number rules out nothing.

        With ``first`` the bars are set here, by the scores of the candidates that the coarsest bound likes best.
        """
        # Rounding of the bounds is far below this share of the norms.
        slack = 1e-9 * (square.max(initial=0) + c_square.max(initial=0)) + 1e-6
        left = np.ones((len(square), len(c_square)), bool)
        self.pairs += left.size
        with np.errstate(all="ignore"):
            for k, (a, b) in enumerate(zip(levels, c_levels, strict=True)):
                # Candidates that no query wants any more are not looked at again, where these are many.
                some = left.any(0) if k else np.ones(left.shape[1], bool)
                if all_of_them := 2 * some.sum() > len(some):
                    some = slice(None)
                b, rest = b[some], c_square[some]
                # (|q|^2 + |c|^2 - distance^2) / 2, with what is one number a row or column put together first.
                bounds = a @ b.T
                bounds += ((square - (a * a).sum(1)) / 2 + slack)[:, None]
                bounds += ((rest - (b * b).sum(1)) / 2)[None, :]
                if first is not None and k == 0 and bounds.shape[1] > SEEDS:
                    q, values, own, top = first
                    likely = np.argpartition(np.where(own, np.inf, -bounds), SEEDS, axis=1)[:, :SEEDS]
                    known = np.where(np.take_along_axis(own, likely, 1), -np.inf, np.einsum("nd,nsd->ns", q, values[likely]))
                    if top <= SEEDS:
                        bar[:] = np.nextafter(np.sort(known, axis=1)[:, -top], -np.inf)
                may = ~(bounds < bar[:, None])
                left = left & may if all_of_them else _within(left, some, may)
                self.left[k] += int(left.sum())
        return np.nonzero(left)


def _within(left: np.ndarray, some: np.ndarray, may: np.ndarray) -> np.ndarray:
    """What is left when only the columns ``some`` may be, where ``may`` holds."""
    out = np.zeros_like(left)
    out[:, some] = left[:, some] & may
    return out


def _rows_of(dim: int) -> int:
    return max(1, min(CANDIDATES, BLOCK_BYTES // (8 * dim)))


_BLOCK = "dim int, ids binary, rows binary, data binary"


def _packed(dim: int, rows: list[int], ids: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in (np.array(ids, "<i8").tobytes(), np.array(rows, "<i8").tobytes(), np.concatenate(values).astype("<f8").tobytes()))]
    return pa.RecordBatch.from_arrays(columns, names=["dim", "ids", "rows", "data"])


def _unpacked(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(block["rows"], "<i8"), np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["data"], "<f8").reshape(-1, block["dim"])


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks (dim, ids, rows, data) of rows (row, id, v), each of one length and bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for row, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                block = held.setdefault(len(x), ([], [], []))
                for part, value in zip(block, (row, i, x), strict=True):
                    part.append(value)
                if len(block[0]) == _rows_of(len(x)):
                    yield _packed(len(x), *held.pop(len(x)))
        for dim in list(held):
            yield _packed(dim, *held.pop(dim))

    return rows.mapInArrow(run, _BLOCK)


def _queries(blocks: DataFrame, every: int) -> DataFrame:
    """Blocks of those rows whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(dim: int) -> pa.RecordBatch:
            rows, ids, values = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            return _packed(dim, rows.tolist(), ids.tolist(), list(values))

        for batch in batches:
            for block in batch.to_pylist():
                rows, ids, values = _unpacked(block)
                asked = ids % every == 0
                if asked.any():
                    held.setdefault(block["dim"], []).append((rows[asked], ids[asked], values[asked]))
                    if sum(len(x[0]) for x in held[block["dim"]]) >= min(QUERIES, _rows_of(block["dim"])):
                        yield packed(block["dim"])
        for dim in list(held):
            yield packed(dim)

    return blocks.mapInArrow(run, _BLOCK)


def top_k(vectors: DataFrame, top: int = TOP, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` best other rows for every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    v = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    whole = v.filter(F.col("id").isNotNull() & (F.size("v") > 0)).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # Row numbers are drawn once, when blocks are written; queries are taken from the same blocks.
    candidates = common.written(_blocks(whole).withColumn("block", F.monotonically_increasing_id()), "topk-candidates")
    queries = common.written(_queries(candidates.select("dim", "ids", "rows", "data"), every).withColumn("block", F.monotonically_increasing_id()), "topk-queries")
    # A group of candidate blocks is one task's work: bounded by its bytes, and small enough for all cores to have some.
    sizes = candidates.groupBy("dim").agg(F.count("*").alias("blocks"), F.max(F.length("data")).alias("bytes"))
    groups = F.greatest(F.ceil(F.col("blocks") * F.col("bytes") / HELD_BYTES), F.least(F.col("blocks"), F.lit(2 * spark.sparkContext.defaultParallelism))).cast("long")
    sizes = common.written(sizes.select("dim", groups.alias("groups")), "topk-groups")
    held = candidates.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("block"), "groups").alias("group"), F.lit(0).alias("kind"), "block", "ids", "rows", "data")
    asked = queries.join(sizes, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), F.lit(1).alias("kind"), "block", "ids", "rows", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, waiting = None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            if blocks and waiting:
                found = blocks[0] if isinstance(blocks[0], Held) else Held(blocks)
                blocks[:] = [found]
                for q_rows, q_ids, q in _joined(waiting, QUERIES):
                    places, ids, scores = found.best(q_rows, q, top)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q_rows[places], q_ids[places], ids, scores)], names=["row", "query_id", "vec_id", "score"])
            waiting.clear()

        for batch in batches:
            for block in batch.to_pylist():
                if (block["dim"], block["group"]) != group:
                    yield from answers()
                    group, blocks[:] = (block["dim"], block["group"]), []
                (waiting if block["kind"] else blocks).append(_unpacked(block))
                if sum(len(x[0]) for x in waiting) >= QUERIES:
                    yield from answers()
        yield from answers()

    partial = held.unionByName(asked).repartition("dim", "group").sortWithinPartitions("dim", "group", "kind", "block").mapInArrow(run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for every 50th."""
    return top_k(common.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
