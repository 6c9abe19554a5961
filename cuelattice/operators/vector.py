"""Exact cosine search over node vectors.

One query is an expression and a top-k (TakeOrderedAndProject).  Up to ``BLOCK``
queries are sent to every task and multiplied as a matrix against Arrow batches
of vectors; every task keeps its own best k for each query, so k rows per query
and task are shuffled, not vectors.  More queries stay in a table, packed to
tiles of ``BLOCK``, and a cross join lets each tile meet each chunk of vectors,
so the driver holds none of them and a task one tile and one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cosine
from ..plans.lineage import cut

#: Queries that are sent to every task at once.
BLOCK = 4096
ROWS = 1024
DECIMALS = 6


def eligible(nodes: DataFrame, node_type: str | None = None) -> DataFrame:
    """Active nodes with a vector, of one type if asked; filtered before anything is scored."""
    rows = nodes.where("embedding IS NOT NULL AND status = 'active'")
    return rows if node_type is None else rows.where(F.col("node_type") == node_type)


def knn(nodes: DataFrame, query: list[float], k: int, node_type: str | None = None) -> DataFrame:
    """(node_id, score) of the k best, score descending, ties by id; nothing for k <= 0 or an empty query."""
    rows = eligible(nodes, node_type)
    q = F.array(*[F.lit(float(x)) for x in query]) if query else F.array().cast("array<double>")
    scored = rows.select(F.col("id").alias("node_id"), F.round(cosine("embedding", q), DECIMALS).alias("score"))
    if k <= 0 or not query:
        return scored.limit(0)
    return scored.orderBy(F.desc("score"), "node_id").limit(k)


class _Best:
    """The k best (score descending, id ascending) so far of each of n queries; ``least`` are scores that k vectors each are known to reach."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k, self.least = k, np.full(n, -np.inf) if least is None else least.copy()
        self.most, self.waiting = max(n * k, 1 << 16), 0
        self.held = [(np.empty(0, np.int64), np.empty(0), np.empty(0, object))]

    def add(self, queries: np.ndarray | None, cosines: np.ndarray, ids: np.ndarray) -> None:
        """Cosines of some queries (all if None) by ids.  Only those that can still be of the k best are rounded and kept."""
        least = self.least if queries is None else self.least[queries]
        new = np.flatnonzero(least == -np.inf)
        if cosines.shape[1] >= self.k and len(new):
            some = cosines if len(new) == len(least) else cosines[new]
            least = least.copy()
            least[new] = np.round(-np.partition(-some, self.k - 1, axis=1)[:, self.k - 1], DECIMALS)
            self.least[slice(None) if queries is None else queries] = least
        row, col = np.nonzero(cosines >= (least - 10.0**-DECIMALS)[:, None])
        scores = np.round(cosines[row, col], DECIMALS) + 0.0
        on = scores >= least[row]
        if not on.any():
            return
        row, col = row[on], col[on]
        self.held.append((row if queries is None else queries[row], scores[on], ids[col]))
        self.waiting += len(row)
        if self.waiting > self.most:
            self.found()

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, scores and ids of the best.  Ids are compared only where scores are equal."""
        rows, scores, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort([-scores, rows])
        same = (np.diff(rows[order]) == 0) & (np.diff(scores[order]) == 0)
        if same.any():
            tied = np.zeros(len(order), bool)
            tied[1:] |= same
            tied[:-1] |= same
            place = np.zeros(len(order), np.int64)
            place[order[tied]] = np.unique(ids[order[tied]].astype(str), return_inverse=True)[1]  # by code point, as Spark orders
            order = np.lexsort([place, -scores, rows])
        of = rows[order]
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        last = order[nth == self.k - 1]
        self.least[rows[last]] = np.maximum(self.least[rows[last]], scores[last])
        order = order[nth < self.k]
        self.held, self.waiting = [(rows[order], scores[order], ids[order])], 0
        return self.held[0]


HITS = "qid string, node_id string, score double"


def _hits(qids: list, best: _Best) -> pa.RecordBatch:
    rows, scores, ids = best.found()
    return pa.RecordBatch.from_arrays([pa.array([qids[i] for i in rows], pa.string()), pa.array(ids.tolist(), pa.string()), pa.array(scores)], names=["qid", "node_id", "score"])


def _lengths(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1)
    length[length == 0] = 1.0
    return length


def scored(qids: list, queries: np.ndarray, k: int, by_cell: dict[int, np.ndarray] | None = None):
    """For mapInArrow over (id, embedding[, cell]): each task's k best for each query; with cells, only for the queries that open a vector's."""
    unit = queries / _lengths(queries)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(qids), k)
        # A block of queries times ROWS vectors at once, so that many queries fit into a worker.
        for b in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            vectors = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            norms = _lengths(vectors)
            ids = np.array(b.column(0).to_pylist(), dtype=object)
            if by_cell is None:
                best.add(None, (unit @ vectors.T) / norms, ids)
                continue
            cells = np.asarray(b.column(2))
            for cell in np.unique(cells):
                own, asked = np.flatnonzero(cells == cell), by_cell[int(cell)]
                best.add(asked, (unit[asked] @ vectors[own].T) / norms[own], ids[own])
        yield _hits(qids, best)

    return run


# ------------------------------------------------------------------ more queries than a block

#: Rows of BLOCK queries or vectors at most.  least: scores below which a query needs no hit; cells: of each vector, in an index.
TILES = "tile long, qids array<string>, queries binary, least binary"
CHUNKS = "ids array<string>, vectors binary, cells binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Rows of (id, embedding, number), BLOCK at most at once."""

    def out(rows: pa.Table) -> tuple:
        ids, vectors, numbers = (rows.column(i).combine_chunks() for i in range(3))
        if len(pc.unique(pc.list_value_length(vectors))) > 1:
            raise ValueError("vectors of different dimensions")
        return ids, np.asarray(vectors.flatten(), np.float64).reshape(len(rows), -1), np.asarray(numbers)

    held, n = [], 0
    for b in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
        if n + b.num_rows > BLOCK and n:
            yield out(pa.Table.from_batches(held))
            held, n = [], 0
        held.append(b)
        n += b.num_rows
    if n:
        yield out(pa.Table.from_batches(held))


def _one(ids: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    for i, (qids, queries, least) in enumerate(_packed(batches)):
        data = [pa.array([x.tobytes()], pa.binary()) for x in (queries / _lengths(queries)[:, None], least)]
        yield pa.RecordBatch.from_arrays([pa.array([first + i]), _one(qids), *data], names=["tile", "qids", "queries", "least"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, vectors, cells in _packed(batches):
        yield pa.RecordBatch.from_arrays([_one(ids), *(pa.array([x.tobytes()], pa.binary()) for x in (vectors, cells))], names=["ids", "vectors", "cells"])


def tiles(queries: DataFrame, n: int, by: str = "qid") -> DataFrame:
    """n queries (qid, embedding[, least]), neighbours by a column together, as rows of BLOCK at most."""
    least = F.coalesce("least", F.lit(float("-inf"))) if "least" in queries.columns else F.lit(float("-inf"))
    dealt = queries.repartitionByRange(-(-n // BLOCK), by).select("qid", F.col("embedding").cast("array<double>"), least)
    return cut(dealt.mapInArrow(_tiles, TILES))


def chunks(rows: DataFrame) -> DataFrame:
    """Vectors (id, embedding[, cell]) as rows of BLOCK at most."""
    cell = F.col("cell") if "cell" in rows.columns else F.lit(0)
    return cut(rows.select("id", F.col("embedding").cast("array<double>"), cell.cast("int")).mapInArrow(_chunks, CHUNKS))


def met(tiles: DataFrame, chunks: DataFrame, k: int, opens: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, only: bool = False) -> DataFrame:
    """(qid, node_id, score): for each query, its k best of each task's vectors.  Each tile meets each chunk; neither goes through the driver.

    ``opens`` gives, from unit queries and least scores, which cells each query opens; others are left out where that
    saves work, or (``only``) in any case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = best = None
        for b in batches:
            for i in range(b.num_rows):
                tile, qids, data, least, ids, vectors, cells = (b.column(c)[i] for c in range(7))
                if tile.as_py() != at:
                    if best is not None:
                        yield _hits(names, best)
                    at, names = tile.as_py(), qids.as_py()
                    unit, least = np.frombuffer(data.as_buffer()).reshape(len(names), -1), np.frombuffer(least.as_buffer())
                    best, which = _Best(len(names), k, least), None if opens is None else opens(unit, least)
                _score(best, unit, which, only, np.array(ids.as_py(), dtype=object), np.frombuffer(vectors.as_buffer()), np.frombuffer(cells.as_buffer(), np.int32))
        if best is not None:
            yield _hits(names, best)

    return tiles.hint("shuffle_replicate_nl").crossJoin(chunks).mapInArrow(run, HITS)


def _score(best: _Best, unit: np.ndarray, which: np.ndarray | None, only: bool, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray) -> None:
    vectors = vectors.reshape(len(ids), -1)
    norms = _lengths(vectors)
    if which is not None:
        names, of = np.unique(cells, return_inverse=True)
        asked = which[:, names]
        if only or (asked.mean(axis=0) @ np.bincount(of)) < len(ids) / 4:  # else one product is less work
            for j in np.flatnonzero(asked.any(axis=0)):
                own, some = np.flatnonzero(of == j), np.flatnonzero(asked[:, j])
                for lo in range(0, len(own), ROWS):
                    part = own[lo : lo + ROWS]
                    best.add(some, (unit[some] @ vectors[part].T) / norms[part], ids[part])
            return
    for lo in range(0, len(ids), ROWS):
        part = slice(lo, lo + ROWS)
        cosines = unit @ vectors[part].T
        cosines /= norms[part]
        best.add(None, cosines, ids[part])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's hits, with their rank."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "node_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_batch(nodes: DataFrame, queries: DataFrame, k: int, node_type: str | None = None) -> DataFrame:
    """(qid, node_id, score, rank) of the k best for each of queries (qid string, embedding)."""
    rows = eligible(nodes, node_type).select("id", "embedding")
    held = queries.select("qid", "embedding").where("embedding IS NOT NULL")
    n = held.count() if k > 0 else 0
    if not n:
        return nodes.sparkSession.createDataFrame([], "qid string, node_id string, score double, rank int")
    if n > BLOCK:
        return ranked(met(tiles(held, n), chunks(rows), k), k)
    found = held.collect()  # BLOCK rows at most
    return ranked(rows.mapInArrow(scored([r.qid for r in found], np.array([r.embedding for r in found], np.float64), k), HITS), k)
