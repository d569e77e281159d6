"""Approximate nearest neighbours: a navigable small-world graph per shard (op 6).

Distinct vectors are dealt to shards: by a hash of their content while there are few shards, else by the
nearest of a number of centroids, and within a centroid's cell by the hash. Every query visits every shard
in the first case, in the second the shards of as many nearest cells as a sample needs to keep ``REACH`` of
its true neighbours. A shard's graph has layers that thin out by ``FAN``; each layer is one flat array of
neighbour rows. Points enter in batches: a batch searches
the graph so far in lockstep, also sees itself, picks diverse neighbours and is linked back. Queries go
down the layers the same way; each shard's best are rescored exactly and merged over shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from folio.llm.common import staged
from folio.llm.vectors import groups, matrix, unit, vectors_of

NEIGHBOURS = 16
FAN = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
BATCH = 256
TOP = 256
SHARD_ROWS = 10_000
#: shards up to which queries visit all; vectors that centroids are fitted on; vectors of these a centroid
ALL_SHARDS, FIT_ROWS, CELL_ROWS = 16, 20_000, 50
#: share of the sample's true neighbours that the visited cells must hold
REACH = 0.99
SEED = 20240630


def beam(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in lockstep: ids (-1: none) and similarities, best first."""
    n, m = len(queries), starts.shape[1]
    width = max(width, m)
    ids = np.full((n, width), -1, np.int64)
    sims = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    seen = np.zeros((n, len(points)), bool)
    rows = np.arange(n)[:, None]
    ids[:, :m] = starts
    ok = starts >= 0
    sims[:, :m] = np.where(ok, np.einsum("nmd,nd->nm", points[np.maximum(starts, 0)], queries), -np.inf)
    done[:, :m] = ~ok
    seen[rows.repeat(m, 1)[ok], starts[ok]] = True
    live = np.arange(n)
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        best = open_.argmax(axis=1)
        going = open_[np.arange(len(live)), best] > -np.inf
        live, best = live[going], best[going]
        if not len(live):
            break
        done[live, best] = True
        near = graph[ids[live, best]]
        fresh = near >= 0
        safe = np.maximum(near, 0)
        fresh &= ~seen[live[:, None], safe]
        who, where = np.nonzero(fresh)
        seen[live[who], near[who, where]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[who, where] = np.einsum("kd,kd->k", points[near[who, where]], queries[live[who]])
        all_sims = np.concatenate([sims[live], found], axis=1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        at = np.arange(len(live))[:, None]
        sims[live] = all_sims[at, keep]
        ids[live] = np.concatenate([ids[live], near], axis=1)[at, keep]
        done[live] = np.concatenate([done[live], ~fresh], axis=1)[at, keep]
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = np.take_along_axis(sims, order, 1)
    return np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1), sims


def diverse(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (rows of ids sorted by similarity, -1: none) those nearer to the point than to any chosen one; then the nearest others."""
    n, width = ids.shape
    v = points[np.maximum(ids, 0)]
    between = np.einsum("nad,nbd->nab", v, v)
    chosen = np.zeros((n, width), bool)
    closest = np.full((n, width), -np.inf, np.float32)
    for c in range(width):
        take = (ids[:, c] >= 0) & (closest[:, c] < sims[:, c]) & (chosen.sum(axis=1) < most)
        chosen[:, c] = take
        closest[take] = np.maximum(closest[take], between[take, c])
    rank = np.where(ids < 0, 3 * width, np.where(chosen, 0, width) + np.arange(width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1)


class Index:
    """Graph over the rows of ``points`` (unit vectors, single precision)."""

    def __init__(self, points: np.ndarray, seed: int = SEED) -> None:
        self.points = np.ascontiguousarray(points, np.float32)
        n = len(points)
        #: rows in random order; layer k has the first sizes[k] of them, the last layer all
        self.order = np.random.default_rng(seed).permutation(n)
        sizes = [n]
        while sizes[0] > TOP:
            sizes.insert(0, max(TOP // 2, sizes[0] // FAN))
        self.sizes = sizes
        self.layers: list[np.ndarray] = []
        for level, size in enumerate(sizes):
            self._build(level, size)

    def _starts(self, queries: np.ndarray, levels: int, width: int = 8) -> np.ndarray:
        top = self.order[: self.sizes[0]]
        s = queries @ self.points[top].T
        m = min(width, len(top))
        starts = top[np.argpartition(-s, m - 1, axis=1)[:, :m]]
        for graph in self.layers[1:levels]:
            starts = beam(self.points, graph, queries, starts, 2 * width)[0][:, :width]
        return starts

    def _build(self, level: int, size: int) -> None:
        points, most = self.points, 2 * NEIGHBOURS
        graph = np.full((len(points), 2 * most), -1, np.int64)
        degree = np.zeros(len(points), np.int64)
        self.layers.append(graph)
        for at in range(0, size, BATCH):
            new = self.order[at : min(size, at + BATCH)]
            q = points[new]
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            m = min(NEIGHBOURS, len(new) - 1)
            ids, sims = np.full((len(new), 0), -1, np.int64), np.full((len(new), 0), -np.inf, np.float32)
            if m > 0:
                near = np.argpartition(-own, m - 1, axis=1)[:, :m]
                ids, sims = new[near], np.take_along_axis(own, near, 1)
            if at:
                # entries come from the layer above, whose points stand first here too
                above = self.sizes[level - 1] if level else 0
                if level and at >= above:
                    starts = self._starts(q, level)
                else:
                    first = self.order[: min(at, TOP)]
                    starts = first[np.argsort(-(q @ points[first].T), axis=1)[:, :8]]
                more, s = beam(points, graph, q, starts, BUILD_WIDTH)
                ids, sims = np.concatenate([ids, more], axis=1), np.concatenate([sims, s], axis=1)
            if not ids.shape[1]:
                continue
            by = np.argsort(-sims, axis=1, kind="stable")
            picked = diverse(points, np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1), NEIGHBOURS)
            graph[new, : picked.shape[1]] = picked
            degree[new] = (picked >= 0).sum(axis=1)
            self._link_back(graph, degree, np.repeat(new, picked.shape[1]), picked.ravel(), most)

    def _link_back(self, graph, degree, source, target, most) -> None:
        ok = target >= 0
        ok[ok] = ~(graph[target[ok]] == source[ok][:, None]).any(axis=1)  # two points of a batch may have picked each other
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            starts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            rank = np.arange(len(target)) - np.repeat(starts, np.diff([*starts, len(target)]))
            slot = degree[target] + rank
            fits = slot < graph.shape[1]
            graph[target[fits], slot[fits]] = source[fits]
            np.add.at(degree, target[fits], 1)
            full = np.unique(target[~fits])
            source, target = source[~fits], target[~fits]
            if len(full):
                held = graph[full]
                sims = np.einsum("nkd,nd->nk", self.points[np.maximum(held, 0)], self.points[full])
                by = np.argsort(-sims, axis=1, kind="stable")
                kept = diverse(self.points, np.take_along_axis(held, by, 1), np.take_along_axis(sims, by, 1), most)
                graph[full] = -1
                graph[full, : kept.shape[1]] = kept
                degree[full] = (kept >= 0).sum(axis=1)

    def search(self, queries: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Ids of the ``k`` best found of each query, best first, -1 where there are fewer."""
        q = np.ascontiguousarray(queries, np.float32)
        starts = self._starts(q, len(self.layers) - 1 if len(self.layers) > 1 else 1)
        return beam(self.points, self.layers[-1], q, starts, max(width, k))[0][:, :k]


def fit_cells(sample: np.ndarray, cells: int, k: int, reach: float = REACH, seed: int = SEED) -> tuple[np.ndarray, int]:
    """Unit centroids of a sample of unit vectors, and how many nearest ones a query has to visit."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(8):
        near = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        centers[norms > 0] = sums[norms > 0] / norms[norms > 0][:, None]
    near = (sample @ centers.T).argmax(axis=1)
    asked = rng.permutation(len(sample))[:1000]
    sims = sample[asked] @ sample.T
    sims[np.arange(len(asked)), asked] = -np.inf
    m = min(k, len(sample) - 1)
    truth = np.argpartition(-sims, m - 1, axis=1)[:, :m]
    order = np.argsort(-(sample[asked] @ centers.T), axis=1)
    rank = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(rank, near[truth], 1).ravel())
    return centers, min(len(centers), 1 + int(needed[min(len(needed) - 1, int(np.ceil(reach * len(needed))))]))


def _with_cells(rows: DataFrame, centers: np.ndarray, visits: int) -> DataFrame:
    """``rows`` and ``cells``, their ``visits`` nearest centroids, nearest first; null for vectors of another length."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            column = batch.column("embedding")
            found: list = [None] * len(column)
            mine = np.flatnonzero(np.array([len(x) for x in column], np.int64) == centers.shape[1])
            for at in range(0, len(mine), 1000):
                some = mine[at : at + 1000]
                sims = matrix(column.take(pa.array(some))) @ centers.T
                order = np.argsort(-sims, axis=1)[:, :visits] if visits > 1 else sims.argmax(axis=1)[:, None]
                for i, row in zip(some.tolist(), order.tolist(), strict=True):
                    found[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cells", ArrayType(IntegerType()))]))


def _dealt(distinct: DataFrame, queries: DataFrame, k: int, shard_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """``shard`` for every distinct vector and ``shard`` rows for every query, and the number of shards."""
    shards = max(1, math.ceil(distinct.count() / shard_rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    hashed = lambda n: F.pmod(F.col("h1"), n).cast("int")
    if shards <= ALL_SHARDS:
        return distinct.withColumn("shard", hashed(F.lit(shards))), queries.withColumn("shard", every), shards
    rows = distinct.select("embedding", "h1", "h2").orderBy("h1", "h2").limit(FIT_ROWS).select("embedding").toArrow().column(0).combine_chunks()
    sizes = np.array([len(x) for x in rows])
    length = int(np.bincount(sizes).argmax())
    sample = unit(matrix(rows.take(pa.array(np.flatnonzero(sizes == length)))))
    centers, visits = fit_cells(sample, max(1, min(shards, len(sample) // CELL_ROWS)), k)
    placed = staged(_with_cells(distinct, centers, 1), "cells")
    own = F.get("cells", F.lit(0))
    counts = {r["cell"]: r["n"] for r in placed.groupBy(own.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [max(1, math.ceil(counts.get(c, 0) / shard_rows)) for c in range(len(centers))]
    first = np.concatenate(([0], np.cumsum(parts))).tolist()
    at = lambda values, c: F.get(F.array(*map(F.lit, values)), c)
    # vectors of other lengths are dealt by hash to shards of their own
    other, total = first[-1], first[-1] + max(1, math.ceil(counts.get(None, 0) / shard_rows))
    place = F.when(F.col("cells").isNull(), other + hashed(F.lit(total - other))).otherwise(at(first, own) + hashed(at(parts, own)))
    cells = F.transform("cells", lambda c: F.sequence(at(first, c), at(first, c) + at(parts, c) - 1))
    visited = F.coalesce(F.flatten(cells), F.sequence(F.lit(other), F.lit(total - 1)))
    asked = _with_cells(queries, centers, visits).withColumn("shard", F.explode(visited))
    return placed.withColumn("shard", place), asked, total


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """``(length, shard, kind)`` and rows of it: a shard's points at once, its queries as their batches come.

    Points are as many as a shard holds, queries as many as the table is large; those are never put together.
    """
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        for values, rows in groups([batch], "length", "shard", "kind"):
            if held and (values != now or values[2] == 1):
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = values
            held += rows.to_batches()
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def search(table: DataFrame, k: int = 5, every: int = 50, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found by cosine of every row whose id is divisible by ``every``.

    All usable rows are indexed. Vectors null, zero or with null or non-finite components, and rows
    without an id, take no part. Of equal vectors the graph holds one, with its ``k + 1`` smallest ids,
    which is all that a list of ``k`` can name. Scores are in double precision on the original vectors,
    ties go to the smaller id. Vectors of other lengths than the query's are no candidates. A table
    without queries gives no rows; other columns, whatever their names, are left out.
    """
    live = vectors_of(table).where("usable").select("vec_id", "embedding", "h1", "h2")
    own = Window.partitionBy("h1", "h2")
    few = live.withColumn("place", F.row_number().over(own.orderBy("vec_id"))).where(F.col("place") <= k + 1)
    distinct = staged(
        few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("embedding", "vec_id").alias("embedding")),
        "distinct",
    )
    points, queries, shards = _dealt(distinct, live.where(F.col("vec_id") % every == 0), k, shard_rows)
    length = F.size("embedding").alias("length")
    points = points.select(length, "shard", F.lit(0).alias("kind"), F.col("ids")[0].alias("id"), "ids", "embedding")
    queries = queries.select(length, "shard", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), F.array().cast("array<long>").alias("ids"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index | None = None
        held: tuple = ()
        for (length, shard, kind), rows in _runs(batches):
            if kind == 0:
                vectors = matrix(rows.column("embedding").combine_chunks())
                index, held = Index(unit(vectors)), (length, shard, vectors, rows.column("ids").to_pylist())
                continue
            if index is None or held[:2] != (length, shard):
                continue
            vectors, names = held[2], held[3]
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            for at in range(0, len(rows), BATCH):
                part = rows.slice(at, BATCH)
                q = matrix(part.column("embedding").combine_chunks())
                found = index.search(unit(q), 4 * k + 4)
                out: list[tuple[int, int, float]] = []
                for i, me in enumerate(part.column("id").to_pylist()):
                    near = found[i][found[i] >= 0]
                    scores = np.einsum("ij,j->i", vectors[near], q[i]) / (norms[near] * np.sqrt(q[i] @ q[i]))
                    hits = [(-s, v) for s, j in zip(scores.tolist(), near.tolist(), strict=True) for v in names[j] if v != me]
                    out += [(me, v, -s) for s, v in sorted(hits)[:k]]
                columns = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )

    found = (
        points.unionByName(queries)
        .repartitionById(shards, "shard")
        .sortWithinPartitions("length", "shard", "kind", "id")
        .mapInArrow(run, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
