"""Exact top-k by inner product with a vector-approximation file.

The file keeps every candidate as a few bits a dimension, its cell, in blocks; the exact
vectors lie in a table of their own.  Queries scan the cells, which bound every score from
both sides.  Candidates that can still be among the best are then read exactly, those
of the highest bounds first, and of the rest only those that the k-th exact score
leaves open: what is not read then cannot be a result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ._common import bounded_batches, stored

#: Rows of a candidate block and of a query block; bits of a cell in each dimension.
BLOCK, QUERY_BLOCK, CELL_BITS = 4096, 512, 5
#: Vectors that a block of queries holds open before those that later blocks have ruled out go.
HELD = 1 << 21
#: So many times k exact vectors are read first for each query.
FIRST = 4
_NULL_ID = np.int64(2**63 - 1)  # a null id sorts last
_LARGEST = 2.0**61  # components stop there
_EXACT = 2.0**52  # sums of integers below are exact as floats


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers; beyond 2**61 they stop there."""
    return np.clip(np.floor(scale * values.astype(np.float64)), -_LARGEST, _LARGEST).astype(np.int64)


def _matrix(lists: list[np.ndarray]) -> np.ndarray:
    """Rows of integers; shorter ones are padded with zeros."""
    out = np.zeros((len(lists), max((len(x) for x in lists), default=0)), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def cells_of(exact: np.ndarray) -> dict[str, np.ndarray]:
    """The cells of the rows of a block, with the place and width of the cells in each dimension."""
    low = exact.min(axis=0) if len(exact) else np.zeros(exact.shape[1], np.int64)
    high = exact.max(axis=0) if len(exact) else low
    width = np.maximum(1, -((low - high - 1) // 2**CELL_BITS))
    return {"low": low, "width": width, "cells": ((exact - low) // width).astype(np.uint8)}


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _padded(x: np.ndarray, dim: int, fill: int = 0) -> np.ndarray:
    return np.concatenate([x, np.full((*x.shape[:-1], dim - x.shape[-1]), fill, x.dtype)], axis=-1)


def bounds(queries: np.ndarray, block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all queries (rows of integers) with all vectors of a block of cells."""
    dim = max(queries.shape[1], len(block["low"]))
    q, low, width = (x.astype(np.float64) for x in (_padded(queries, dim), _padded(block["low"], dim), _padded(block["width"], dim, 1)))
    cells = _padded(block["cells"], dim).astype(np.float64)
    base = (q * width) @ cells.T + (q @ low)[:, None]
    slack = width - 1
    below, above = np.minimum(q, 0) @ slack, np.maximum(q, 0) @ slack
    reach = float(np.abs(q).max(initial=0)) * float((np.abs(low) + width * 2**CELL_BITS).max(initial=0)) * max(dim, 1)
    loss = 0.0 if reach < _EXACT else reach * max(dim, 1) * 2.0**-50  # what rounding can take
    ends = (-(2.0**63), 2.0**63)  # scores stop there, and are ties then
    return np.clip(base + (below - loss)[:, None], *ends), np.clip(base + (above + loss)[:, None], *ends)


class Open:
    """What the blocks that a task has seen leave open for the queries of a block: their k highest lower bounds, and the
    vectors whose upper bounds reach the k-th of these."""

    def __init__(self, queries: dict[str, np.ndarray], k: int):
        self.asks, self.ids, self.exact, self.k = queries["ask"], queries["ids"], queries["exact"], k
        self.best = np.full((len(self.ids), k), -np.inf)
        self.held: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []  # block; queries, places and upper bounds
        self.size = 0

    def add(self, name: str, block: dict[str, np.ndarray]) -> None:
        lower, upper = bounds(self.exact, block)
        lower[self.ids[:, None] == block["ids"]] = -np.inf
        n = min(self.k, lower.shape[1])
        self.best = np.partition(np.concatenate([self.best, np.partition(lower, lower.shape[1] - n, axis=1)[:, lower.shape[1] - n :]], axis=1), n, axis=1)[:, n:]
        query, place = np.nonzero((upper >= self.best.min(1)[:, None]) & (lower > -np.inf))
        self.held.append((name, query, place, upper[query, place]))
        self.size += len(query)
        if self.size > HELD:
            self.prune()

    def prune(self) -> None:
        """Leave out what later blocks have ruled out."""
        least = self.best.min(1)
        self.held = [(name, q[on], at[on], up[on]) for name, q, at, up in self.held if (on := up >= least[q]).any()]
        self.size = sum(len(h[1]) for h in self.held)

    def rows(self, places: dict[str, np.ndarray]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
        """ask, block, lower bounds (once for each query), places and upper bounds."""
        self.prune()
        told = np.zeros(len(self.ids), bool)
        for name, query, at, up in self.held:
            cut = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]]))
            for a, z in zip(cut, cut[1:], strict=False):
                q = query[a]
                own = self.best[q] if not told[q] else self.best[q, :0]
                told[q] = True
                yield self.asks[q], name, own[own > -np.inf], places[name][at[a:z]], up[a:z]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row inner products of integers; those that a long cannot hold stop at its ends."""
    size = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    if size < 2.0**62:
        return np.einsum("ij,ij->i", left, right)
    exact = (left.astype(object) * right.astype(object)).sum(axis=1)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)


def _exact_scores(batches):
    """From query, rank key, candidate and both vectors: query, id and score."""
    for b in batches:
        left, right = (_matrix([np.asarray(v.values, np.int64) for v in b.column(i)]) for i in (3, 4))
        dim = max(left.shape[1], right.shape[1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(products(_padded(left, dim), _padded(right, dim)))], names=["ask", "query_id", "vec_id", "score"])


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Each query's k best rows: query_id, rank (from 1), vec_id, score.

    Components count as floor(scale * x), between -2**61 and 2**61; the score is the integer inner product,
    which stops at the ends of a long.  A query is compared with every row but those of its own id; ties
    go to the smaller id.  With fewer than k other rows all are returned; a query without any has no row.
    Vectors that are null or hold null or non-finite components take no part, on either
    side; shorter vectors are padded with zeros.  A null id can be found, after all other
    ids of its score, and cannot ask.  A repeated query row is answered each time, a
    repeated vector found each time.  Empty tables give an empty result; only the two
    named columns are read.  Query blocks meet candidate blocks through a numbered
    partition of the candidates, so no task holds more than two blocks of cells at once, and of
    the vectors that are open only those that the best bounds of all its blocks leave open are passed on.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    groups = max(8, 4 * spark.sparkContext.defaultParallelism)

    def usable(df: DataFrame) -> DataFrame:
        x = F.col("v")
        fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(x.isNotNull() & fine)

    def numbered(batches):
        """Rows of integers, each with the name of its block and its place there."""
        import uuid

        name, at = uuid.uuid4().hex, 0
        for b in batches:
            ids, own = b.column(0), b.column(1)
            places = [(name, at + i) for i in range(b.num_rows)]
            if at + b.num_rows > BLOCK:
                over = max(0, BLOCK - at)
                rest = [uuid.uuid4().hex for _ in range(-(-(b.num_rows - over) // BLOCK))]
                places = [(name, at + i) if i < over else (rest[(i - over) // BLOCK], (i - over) % BLOCK) for i in range(b.num_rows)]
            name, at = places[-1][0], places[-1][1] + 1
            ints = [scaled(np.asarray(v.values), scale) for v in own]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in places]), pa.array([p[1] for p in places], pa.int32()), ids, pa.array(ints, pa.list_(pa.int64()))], names=["block", "at", "id", "v"])

    def approximated(batches):
        """The cells of each block; rows of a block are neighbours."""
        import random

        held, name = [], None

        def block():
            ids = np.array([_NULL_ID if h[1] is None else h[1] for h in held], np.int64)
            data = _pack(at=np.array([h[0] for h in held], np.int32), ids=ids, **cells_of(_matrix([h[2] for h in held])))
            return pa.RecordBatch.from_arrays([pa.array([random.randrange(groups)], pa.int32()), pa.array([name]), pa.array([data], pa.binary())], names=["g", "block", "cells"])

        for b in batches:
            for own, at, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if own != name:
                    if held:
                        yield block()
                    held, name = [], own
                held.append((at, i, np.asarray(v.values)))
        if held:
            yield block()

    def asking(batches):
        """Queries in blocks, to go to every group of candidate blocks."""
        held = []

        def block():
            data = _pack(ask=np.array([h[0] for h in held], np.int64), ids=np.array([h[1] for h in held], np.int64), exact=_matrix([h[2] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["queries"])

        for b in batches:
            for ask, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                held.append((ask, i, np.asarray(v.values)))
                if len(held) == QUERY_BLOCK:
                    yield block()
                    held = []
        if held:
            yield block()

    def scan(batches):
        """For each query of a run of rows: the highest lower bounds of its blocks, and the vectors they leave open with their upper bounds."""
        asked, state, places = None, None, {}

        def out():
            rows = []

            def batch():
                return pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.list_(pa.float64()))],
                    names=["ask", "block", "lower", "at", "upper"],
                )

            for r in state.rows(places):
                rows.append(r)
                if len(rows) == 512:
                    yield batch()
                    rows = []
            if rows:
                yield batch()

        for b in batches:
            for name, cells, asks in zip(*(b.column(i) for i in range(3)), strict=True):
                if asks.as_py() != asked:
                    if state is not None:
                        yield from out()
                    asked, places = asks.as_py(), {}
                    state = Open(_unpack(asked), k)
                block = _unpack(cells.as_py())
                places[name.as_py()] = block["at"]
                state.add(name.as_py(), block)
        if state is not None:
            yield from out()

    # stored, as the names are drawn once: the exact vectors by block and place, and the cells
    exact = stored(usable(vectors).mapInArrow(numbered, "block string, at int, id long, v array<long>"))
    cells = stored(exact.repartition("block").sortWithinPartitions("block", "at").mapInArrow(approximated, "g int, block string, cells binary"))
    own = usable(queries).filter("id is not null").mapInArrow(numbered, "block string, at int, id long, v array<long>")
    asks = stored(own.select(F.xxhash64("block", "at").alias("ask"), "id", "v"))
    blocks = asks.mapInArrow(asking, "queries binary").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "queries")
    # merged: the copies of the query blocks are many times the table of queries whose size the planner sees, too many to be broadcast through the driver;
    # and a query block's rows come one after the other, as the join keeps its left side's order (in any other they give more rows, not others)
    found = stored(blocks.hint("merge").join(cells, "g").select("block", "cells", "queries").mapInArrow(scan, "ask long, block string, lower array<double>, at array<int>, upper array<double>"))

    def kth(rows: DataFrame, value: str) -> DataFrame:
        """The k-th highest value of each query that has so many."""
        place = F.row_number().over(W.partitionBy("ask").orderBy(F.desc(value)))
        return rows.withColumn("n", place).filter(F.col("n") <= k).groupBy("ask").agg(F.min(value).alias("least"), F.count("*").alias("there")).filter(F.col("there") == k).select("ask", "least")

    certain = kth(found.select("ask", F.explode("lower").alias("low")), "low")
    near = found.join(certain, "ask", "left").select("ask", "block", "least", F.explode(F.arrays_zip("at", "upper")).alias("c")).select("ask", "block", "c.at", "c.upper", "least")
    near = near.filter("least is null or upper >= least").drop("least")
    near = stored(near.withColumn("order", F.row_number().over(W.partitionBy("ask").orderBy(F.desc("upper"), "block", "at"))))

    def read(some: DataFrame) -> DataFrame:
        asked = some.join(asks.select("ask", F.col("id").alias("query_id"), F.col("v").alias("q")), "ask")
        both = asked.join(exact, ["block", "at"]).select("ask", "query_id", F.coalesce("id", F.lit(int(_NULL_ID))).alias("vec_id"), "q", "v")
        return both.mapInArrow(_exact_scores, "ask long, query_id long, vec_id long, score long")

    first = stored(read(near.filter(F.col("order") <= FIRST * k)))
    rest = near.filter(F.col("order") > FIRST * k).join(kth(first, "score"), "ask", "left").filter("least is null or upper >= least").drop("least")
    place = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    best = first.unionByName(read(rest)).withColumn("rank", place).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(F.col("vec_id") != int(_NULL_ID), F.col("vec_id")).alias("vec_id"), "score")
