"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes a vector by a pseudo-rotation, three rounds of random signs and a fast
Hadamard transform, and names the signed axis nearest to the result: one of ``2 * D``
cells for D axes. A query looks into the cells of its ``PROBES`` nearest signed axes in
each of ``TABLES`` tables, and scores exactly every row that it meets in any of them, on
the original vectors.

Angles order candidates as inner products do where all have one norm. Where the norms of
the candidates at hand differ, hashing gives them one more axis that fills each up to
the longest; a query has 0 there, so no inner product changes.

Candidates are dealt by hash into groups of bounded bytes. A task holds the tables of one
group and reads all queries as a stream, so memory does not grow with the input, with the
largest cell or with copies of one vector, and pairs never leave a task: only the best
``top`` of a query and group do.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows without an id; vectors of different lengths never meet; each
row is a query or candidate by itself, so a query meets other rows of its own id, and
each row of an id that repeats among queries has its own ranks; equal scores go to the
smaller id; a sum that overflows is infinite, one without a value (infinities of both
signs) counts as negative infinity; a query that meets nothing has no rows; an empty
table gives no rows; extra columns are not read. Texts are not involved; a very long
vector makes its groups hold fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreef.llm import common

TOP, EVERY = 20, 20
#: Hash tables, cells that a query looks into in each, rounds of a rotation, and the seed of its signs.
TABLES, PROBES, ROUNDS, SEED = 16, 10, 3, 20
#: Bytes of the candidate values of a group, and rows that are hashed at once.
HELD_BYTES, CHUNK = 1 << 25, 4096
#: Norms within this share of the longest count as equal.
LEVEL = 1e-3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in n log n steps; the length is a power of two."""
    rows, n = x.shape
    half = 1
    while half < n:
        pairs = x.reshape(rows, n // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, n)
        half *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Rows after the pseudo-rotation of a table, padded to a power of two."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, table, size]).choice([-1.0, 1.0], (ROUNDS, size))
    for s in signs:
        y = hadamard(y * s)
    return y


def cells(x: np.ndarray, table: int) -> np.ndarray:
    """The cell of each row: twice its nearest axis, one more if on the negative side."""
    y = rotated(x, table)
    axis = np.abs(y).argmax(1)
    return 2 * axis + (y[np.arange(len(y)), axis] < 0)


def probes(x: np.ndarray, table: int, n: int) -> np.ndarray:
    """The n cells nearest to each row, nearest first."""
    y = rotated(x, table)
    signed = np.stack((y, -y), axis=2).reshape(len(y), -1)
    n = min(n, signed.shape[1])
    some = np.argpartition(-signed, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(signed, some, 1), axis=1, kind="stable"), 1)


class Tables:
    """Hash tables over some candidates: row numbers, ids and vectors of one length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, tables: int = TABLES):
        self.rows, self.ids, self.values = rows, ids, values
        largest = np.abs(values).max()
        norms = np.sqrt(np.square(values / largest).sum(1))
        longest = norms.max()
        #: Whether hashing adds an axis that gives all the same norm.
        self.level = bool(norms.min() < longest * (1 - LEVEL))
        fill = np.sqrt(np.maximum(longest * longest - norms * norms, 0))
        self.orders, self.starts = [], []
        for table in range(tables):
            found = [cells(self._hashed(values[i : i + CHUNK] / largest, fill[i : i + CHUNK]), table) for i in range(0, len(values), CHUNK)]
            cell = np.concatenate(found)
            order = np.argsort(cell, kind="stable")
            self.orders.append(order)
            self.starts.append(np.searchsorted(cell[order], np.arange(self._cells() + 1)))
        #: Pairs that were scored, and all.
        self.met, self.pairs = 0, 0

    def _hashed(self, x: np.ndarray, fill: np.ndarray | float) -> np.ndarray:
        return np.column_stack((x, np.broadcast_to(fill, len(x)))) if self.level else x

    def _cells(self) -> int:
        return 2 << max(0, (self.values.shape[1] + self.level - 1).bit_length())

    def nearest(self, q_rows: np.ndarray, q: np.ndarray, top: int, n_probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and score of the best ``top`` that each query meets, but for its own row."""
        unit = self._hashed(q / np.abs(q).max(1, keepdims=True), 0.0)
        asked = [probes(unit, table, n_probes) for table in range(len(self.orders))]
        places, ids, scores = [], [], []
        seen = np.zeros(len(self.rows), bool)
        for i, row in enumerate(q_rows):
            for order, starts, wanted in zip(self.orders, self.starts, asked, strict=True):
                for cell in wanted[i]:
                    seen[order[starts[cell] : starts[cell + 1]]] = True
            met = np.flatnonzero(seen)
            seen[met] = False
            met = met[self.rows[met] != row]
            self.met += len(met)
            self.pairs += len(self.rows)
            with np.errstate(all="ignore"):
                score = self.values[met] @ q[i]
            score[np.isnan(score)] = -np.inf
            if len(met) > top:
                some = score >= np.partition(score, len(score) - top)[len(score) - top]
                met, score = met[some], score[some]
            best = np.lexsort((self.ids[met], -score))[:top]
            places.append(np.full(len(best), i))
            ids.append(self.ids[met[best]])
            scores.append(score[best])
        return np.concatenate(places), np.concatenate(ids), np.concatenate(scores)


_FOUND = "row long, query_id long, vec_id long, score double"


def _search(top: int, tables: int, n_probes: int):
    """Arrow batches of rows (dim, group, kind, row, id, v), each group's candidates (kind 0) before its queries, to found pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, built = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                dim, number, kind = keys[a].tolist()
                part = batch.slice(a, b - a)
                rows, ids = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
                values = part.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                if (dim, number) != group:
                    group, held, built = (dim, number), [], None
                if kind == 0:
                    held.append((rows, ids, values))
                elif held or built:
                    if built is None:
                        built, held = Tables(*(np.concatenate(x) for x in zip(*held, strict=True)), tables), []
                    places, found, scores = built.nearest(rows, values, top, n_probes)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[places], pa.int64()), pa.array(ids[places], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], names=["row", "query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, n_probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` nearest other rows found for every row whose id is divisible by ``every``."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    whole = v.filter(F.col("id").isNotNull() & (F.size("v") > 0)).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    # Row numbers are drawn once, when the rows are written.
    rows = common.written(whole.select(F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"), "id", "v"), "polytope-rows")
    # As many groups of one length as its bytes ask for, and at least as many as keep all cores busy.
    cores = F.lit(2 * vectors.sparkSession.sparkContext.defaultParallelism)
    groups = F.greatest(F.ceil(F.count("*") * F.col("dim") * 8 / HELD_BYTES), F.least(F.count("*"), cores)).cast("int")
    sizes = common.written(rows.groupBy("dim").agg(groups.alias("groups")), "polytope-groups")
    dealt = rows.join(sizes, "dim")
    held = dealt.select("dim", F.pmod(F.xxhash64("row"), "groups").cast("int").alias("group"), F.lit(0).alias("kind"), "row", "id", "v")
    asked = dealt.filter(F.pmod("id", F.lit(every)) == 0).select("dim", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(1).alias("kind"), "row", "id", "v")
    partial = held.unionByName(asked).repartition("dim", "group").sortWithinPartitions("dim", "group", "kind").mapInArrow(_search(top, tables, n_probes), _FOUND)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings found for every 20th."""
    return nearest(common.table(spark, sf_dir, "embeddings"))
