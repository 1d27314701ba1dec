"""Nearest neighbours by inner product with a vantage-point tree in each shard.

Largest inner products are smallest distances once every vector gets one more component that brings it to the length
of the longest (and the query a zero).  A tree node splits its points by their distance to a vantage point and keeps
the range of distances on each side.  By the triangle inequality a side can't hold anything nearer than the gap between
its range and the query's own distance; it is left out if that gap, times a factor, is beyond the worst neighbour found
so far.  Factor 1 is exact search; larger factors leave out more.

Shards are cells around vantage points too (the points nearest to one of at most ``CELLS`` sampled vectors), so the same
rule leaves out whole shards: a query first searches the shard nearest to it, and is then sent only to shards whose
range of distances can hold something better than what it has found there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored
from .texts import bound_batches, tidied

#: Most vectors in a shard, most queries in a block, points in a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF = 32_768, 8192, 128
#: Vectors that a cell has on average while there are fewer than ``CELLS`` of them; most cells, of the ``DIMS`` commonest
#: lengths of vectors (vectors of other lengths have one cell).
CELL_ROWS, CELLS, DIMS = 4096, 256, 8
#: Room for rounding when a side is left out.
SLACK = 1e-9


@dataclass
class Node:
    """A leaf has points; an inner node has a vantage point, two sides and the range of distances on each."""

    points: np.ndarray
    vantage: int = -1
    near: Node | None = None
    far: Node | None = None
    ranges: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    middle: float = 0.0


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` with the same row of ``b``, summed component by component, so that equal rows get equal sums."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def lifted(vectors: np.ndarray, bound: float) -> np.ndarray:
    """The vectors with one more component, which brings them to the square length ``bound``."""
    return np.column_stack([vectors, np.sqrt(np.maximum(0.0, bound - (vectors**2).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every row of ``a`` to every row of ``b``."""
    return np.sqrt(np.maximum(0.0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T)))


class Tree:
    """A vantage-point tree over the rows of ``vectors``; ``ids`` break ties (smaller first)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, seed: int = 3):
        self.x, self.ids = vectors, ids
        self.bound = float((vectors**2).sum(axis=1).max()) if len(vectors) else 0.0
        self.lifted = lifted(vectors, self.bound)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, points: np.ndarray) -> Node:
        if len(points) <= LEAF:
            return Node(points)
        # of some points, the one whose distances to others differ most
        tried = self.rng.choice(points, min(8, len(points)), replace=False)
        seen = self.rng.choice(points, min(128, len(points)), replace=False)
        vantage = int(tried[distances(self.lifted[tried], self.lifted[seen]).std(axis=1).argmax()])
        d = np.sqrt(((self.lifted[points] - self.lifted[vantage]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        points, d, half = points[order], d[order], len(points) // 2
        return Node(points[:0], vantage, self._build(points[:half]), self._build(points[half:]), (d[0], d[half - 1], d[half], d[-1]), float(d[half]))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: none) and inner products of the ``k`` nearest of each query but its own row, and how many points it saw.

        ``floor``: inner products below it aren't wanted.
        """
        self.q, self.q_ids, self.factor = queries, query_ids, factor
        self.q_square = (queries**2).sum(axis=1)
        self.q_lifted = np.column_stack([queries, np.zeros(len(queries))])
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.looked = np.zeros(len(queries), np.int64)
        self._visit(self.root, np.arange(len(queries)))
        return np.where(np.isinf(self.best), -1, self.found), self.best, self.looked

    def _least(self, active: np.ndarray) -> np.ndarray:
        """The inner product that a point must reach to count."""
        return np.maximum(self.best[active, -1], self.floor[active])

    def _visit(self, node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.near is None:
            return self._look(node.points, active)
        d = np.sqrt(((self.q_lifted[active] - self.lifted[node.vantage]) ** 2).sum(axis=1))
        a, b, c, e = node.ranges
        sides = ((node.near, np.maximum(a - d, d - b)), (node.far, np.maximum(c - d, d - e)))
        inner = d < node.middle
        for first in (0, 1):  # each query goes to its own side first
            own = inner if first == 0 else ~inner
            for side, gap in (sides[first], sides[1 - first]):
                worst = np.sqrt(np.maximum(0.0, self.q_square[active] + self.bound - 2 * self._least(active)))
                self._visit(side, active[own & (np.maximum(gap, 0) * self.factor <= worst * (1 + SLACK) + SLACK)])

    def _look(self, points: np.ndarray, active: np.ndarray) -> None:
        self.looked[active] += len(points)
        room = SLACK * np.sqrt(self.q_square[active] * self.bound)
        q, p = np.nonzero(self.q[active] @ self.x[points].T >= (self._least(active) - room)[:, None])
        q, p = active[q], points[p]
        other = self.q_ids[q] != self.ids[p]
        q, p = q[other], p[other]
        if not len(q):
            return
        hit = np.unique(q)
        k = self.best.shape[1]
        who = np.concatenate([np.repeat(hit, k), q])
        score = np.concatenate([self.best[hit].ravel(), inner_products(self.q[q], self.x[p])])
        ids = np.concatenate([self.found[hit].ravel(), self.ids[p]])
        order = np.lexsort((ids, -score, who))
        nth = np.arange(len(who)) - np.repeat(np.searchsorted(who[order], hit), np.unique(who, return_counts=True)[1])
        order = order[nth < k]
        self.best[hit], self.found[hit] = score[order].reshape(-1, k), ids[order].reshape(-1, k)


def _distinct(vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep: of equal vectors the ``most`` with the smallest ids, as no search returns more of them."""
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, which = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, which))
    w = which[order]
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    nth = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
    return np.sort(order[nth < most])


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) if isinstance(column, pa.Array) else _matrix(column.combine_chunks(), size)


class Cells:
    """The vantage points of shards: for each length of vectors, sampled vectors, lifted, and the ranges around them."""

    def __init__(self, sample: dict[int, np.ndarray], bounds: dict[int, float]):
        self.bounds = bounds
        self.pivots = {dim: lifted(x, bounds[dim]) for dim, x in sample.items()}
        self.ranges: dict[int, np.ndarray] = {}

    def of_points(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its distance there (0 and 0 where there are no cells)."""
        if dim not in self.pivots:
            return np.zeros(len(x), np.int64), np.zeros(len(x))
        d = distances(lifted(x, self.bounds[dim]), self.pivots[dim])
        return d.argmin(axis=1), d.min(axis=1)

    def of_queries(self, dim: int, q: np.ndarray, least: np.ndarray | None, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Which cells each query has to see (query, cell): the nearest one without ``least``, else all that can reach it."""
        if dim not in self.pivots:
            return np.arange(len(q)), np.zeros(len(q), np.int64)
        d = distances(np.column_stack([q, np.zeros(len(q))]), self.pivots[dim])
        used = self.ranges[dim][:, 0] <= self.ranges[dim][:, 1]
        if least is None:
            return np.arange(len(q)), np.where(used, d, np.inf).argmin(axis=1)
        gap = np.maximum(0.0, np.maximum(self.ranges[dim][:, 0] - d, d - self.ranges[dim][:, 1]))
        worst = np.sqrt(np.maximum(0.0, (q**2).sum(axis=1) + self.bounds[dim] - 2 * least))
        return np.nonzero(used & (gap * factor <= (worst * (1 + SLACK) + np.sqrt(SLACK) * (1 + worst))[:, None]))


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of vectors in a batch, the rows that have it, and their vectors as a matrix."""
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, _matrix(batch.column(column).take(pa.array(at)), dim)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, with_looked: bool = False) -> DataFrame:
    """The ``k`` rows with the largest inner product for each query row: query_id, rank (from 1), ``id_col``, score.

    Ids are integers.  Ties go to the smaller id.  A query's own row is no candidate, nor is any row with its id.  Rows
    whose id or vector is null, whose vector is empty, zero or holds null or non-finite components take no part; vectors
    of another length than the query's are no candidates.  Rows that repeat an id and a vector count once.  Fewer
    candidates than ``k`` give fewer rows; an empty table gives none.  ``with_looked`` adds how many vectors the query
    was compared with.

    Scale: a stated set of queries against all rows, in blocks.  The driver holds at most ``CELLS`` vectors for each of
    ``DIMS`` lengths and the cells' ranges.  A cell with more than ``shard_rows`` vectors is dealt to several shards, so
    a vector that a third of the rows have is spread (and kept ``k + 1`` times in a shard, which is exact).  A shard
    gets only the queries that its range can serve, in blocks of about ``block_rows``, and is copied for each of these
    blocks; it answers with at most ``k`` rows a query, none worse than what the query found in its nearest shard.  How
    much is left out depends on the data: vectors without any clusters in many dimensions are all looked at.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    v, i = F.col(f"`{vector_col}`").cast("array<double>"), F.col(f"`{id_col}`").cast("bigint")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(i.isNotNull() & F.coalesce(sound, F.lit(False))).select(i.alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    by_dim = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("bound")).orderBy(F.desc("n"), "dim").limit(DIMS).collect()
    sample = {r["dim"]: rows.where(F.size("v") == r["dim"]).orderBy(F.xxhash64("id"), "id").limit(min(CELLS, r["n"] // cell_rows)).select("v").toArrow() for r in by_dim if r["n"] >= 2 * cell_rows}
    cells = Cells({dim: _matrix(t.column("v"), dim) for dim, t in sample.items()}, {r["dim"]: r["bound"] * (1 + SLACK) for r in by_dim})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_length(batch, 1):
                cell, d = cells.of_points(dim, x)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(d), *part.columns], names=["dim", "cell", "d", "id", "v", "asked"])

    placed = stored(rows.mapInArrow(tidied(place), "dim int, cell int, d double, id bigint, v array<double>, asked boolean"))
    shards = stored(placed.groupBy("dim", "cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.ceil(F.count("*") / shard_rows).cast("int").alias("subs")))
    for dim, pivots in cells.pivots.items():
        cells.ranges[dim] = np.tile([np.inf, -np.inf], (len(pivots), 1))
        for r in shards.where(F.col("dim") == dim).collect():  # at most CELLS rows
            cells.ranges[dim][r["cell"]] = r["lo"], r["hi"]
    key = ["dim", "cell", "sub"]
    named = shards.select("dim", "cell", "subs")
    points = placed.join(named, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("id"), "subs").cast("int").alias("sub"), "id", "v")
    queries = placed.where("asked").select("id", "v", F.xxhash64("v").alias("tag"), F.lit(float("-inf")).alias("least"))

    def route(every: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, at, q in _by_length(batch, 1):
                    least = batch.column(3).to_numpy()[at]
                    who, cell = cells.of_queries(dim, q, least if every else None, factor)
                    for a in range(0, len(who), 4096):
                        part = batch.take(pa.array(at[who[a : a + 4096]]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, dim, np.int32)), pa.array(cell[a : a + 4096].astype(np.int32)), *part.columns], names=["dim", "cell", "id", "v", "tag", "least"])

        return tidied(run)

    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, [np.zeros(0)] * 2, [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2]
        if points.num_rows and queries.num_rows:
            size = points.column("dim")[0].as_py()
            x, ids = _matrix(points.column("v"), size), points.column("id").to_numpy()
            keep = _distinct(np.column_stack([x, ids.view(np.float64)]), ids, 1)
            x, ids = x[keep], ids[keep]
            keep = _distinct(x, ids, k + 1)
            order = keep[np.argsort(ids[keep], kind="stable")]
            q, q_ids = _matrix(queries.column("v"), size), queries.column("id").to_numpy()
            one = _distinct(np.column_stack([q, q_ids.view(np.float64)]), q_ids, 1)
            q, q_ids, tag, least = q[one], q_ids[one], queries.column("tag").to_numpy()[one], queries.column("least").to_numpy()[one]
            found, score, looked = Tree(x[order], ids[order]).search(q, q_ids, k, factor, least)
            there = ~np.isinf(score)
            n = there.sum(axis=1)
            none = np.zeros(0, np.int64)
            out = [[np.repeat(q_ids, n), q_ids], [np.repeat(tag, n), tag], [score[there], np.full(len(q), np.nan)], [found[there], none], [none, looked]]
        ids = pa.concat_arrays([pa.array(out[3][0], pa.int64()), pa.nulls(len(out[0][1]), pa.int64())])
        looked = pa.concat_arrays([pa.nulls(len(out[0][0]), pa.int64()), pa.array(out[4][1], pa.int64())])
        return pa.table([pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.int64()), pa.array(np.concatenate(out[2])), ids, looked], names=["query_id", "tag", "score", "id", "looked"])

    def answers(routed: DataFrame) -> DataFrame:
        """Rows with an id are neighbours, the one without says how many vectors of a shard the query was compared with."""
        blocks = stored(routed.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
        copies = points.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        asked = routed.join(blocks, key).withColumn("block", F.pmod(F.xxhash64(F.col("id") + 1), "blocks").cast("int")).drop("blocks")
        return copies.groupBy(*key, "block").cogroup(asked.groupBy(*key, "block")).applyInArrow(search, "query_id bigint, tag bigint, score double, id bigint, looked bigint")

    schema = "dim int, cell int, id bigint, v array<double>, tag bigint, least double"
    known = queries
    if cells.pivots:  # else a length's vectors are one cell, and the nearest shard is no better than any
        home = queries.mapInArrow(route(False), schema).join(named, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int")).drop("subs")
        first = stored(answers(home).where("id IS NOT NULL").groupBy("query_id", "tag").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k))
        known = stored(queries.join(first, (F.col("id") == F.col("query_id")) & (queries.tag == first.tag), "left").select("id", "v", queries.tag, F.coalesce("low", "least").alias("least")))
    routed = known.mapInArrow(route(True), schema).join(named, ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
    got = answers(routed)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = got.where("id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
    return best.join(got.groupBy("query_id").agg(F.sum("looked").alias("looked")), "query_id") if with_looked else best
