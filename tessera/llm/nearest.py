"""Operator 10: exact nearest neighbours by cosine with a block matrix join.

Queries and rows meet in tiles. A tile's product of int8-quantised unit vectors gives every cosine to within a proven
bound; only pairs that could still be among a query's k best are recomputed in double precision from the original
vectors and kept in a heap per query. Each task keeps one heap for each query over all its rows, and the heaps of all
tasks are merged. Queries go to the tasks in blocks of bounded size, one after the other, so no pair and no vector is
shuffled and the driver holds one block, however many queries there are.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table

#: Numbers of query vectors broadcast at once (8 bytes each), and rows and queries of a tile.
BLOCK, TILE = 4_000_000, 1024
_PAIRS = 200_000


def vectors(col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and float64 vectors of those that take part (no nulls, all finite, not zero)."""
    lens = np.diff(col.offsets.to_numpy(zero_copy_only=False))
    start = col.offsets.to_numpy(zero_copy_only=False)
    whole = col.values.cast(pa.float64())
    flat = whole.to_numpy(zero_copy_only=False)  # nulls become NaN
    valid = np.ones(len(col), bool) if col.null_count == 0 else col.is_valid().to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(lens[valid]):
        at = np.flatnonzero(valid & (lens == d))
        if d:
            x = flat[start[at][:, None] + np.arange(d)]
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            if ok.any():
                out[int(d)] = at[ok], np.ascontiguousarray(x[ok])
    return out


class Tile:
    """Unit vectors as int8 with a scale each; ``err`` bounds what rounding loses of each."""

    def __init__(self, x: np.ndarray):
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        back = self.q * self.scale[:, None]
        self.err = np.sqrt(((unit - back) ** 2).sum(axis=1))
        self.size = np.sqrt((back**2).sum(axis=1))
        self.lanes = self.q.astype(np.float32 if x.shape[1] <= 1024 else np.float64)  # products of int8 stay exact


def bounds(a: Tile, b: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Approximate cosines and how far off they can be: |u.v - u'.v'| <= |eu||v'| + |u||ev|."""
    got = (a.lanes @ b.lanes.T) * a.scale[:, None] * b.scale[None, :]
    return got, a.err[:, None] * b.size[None, :] + b.err[None, :] + 1e-6


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, added up from left to right, so that equal rows give equal bits wherever they stand."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In double precision; on scaled copies where squares could overflow or vanish."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) if (np.abs(v).max() > 1e100 or np.abs(v).max(axis=1).min() < 1e-100) else v for v in (x, y))
    return _dots(x, y) / (np.sqrt(_dots(x, x)) * np.sqrt(_dots(y, y)))


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = defaultdict(list)  # query: its best so far, worst first, as (score, -vec_id)
        tiles = {d: [(ids[i : i + TILE], x[i : i + TILE], Tile(x[i : i + TILE])) for i in range(0, len(ids), TILE)] for d, (ids, x) in shared.value.items()}
        floor = {d: [np.full(len(ids), -np.inf) for ids, _, _ in t] for d, t in tiles.items()}
        for b in batches:
            vec_ids = b.column(0).to_numpy(zero_copy_only=False)
            for d, (at, x) in vectors(b.column(1)).items():
                for i in range(0, len(at), TILE):
                    ids, rows = vec_ids[at[i : i + TILE]], x[i : i + TILE]
                    tile = Tile(rows) if d in tiles else None
                    by_id = np.argsort(ids, kind="stable")
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(ids[by_id]) != 0]))
                    kinds = len(starts)
                    for t, (qids, qx, qtile) in enumerate(tiles.get(d, [])):
                        got, off = bounds(qtile, tile)
                        own = qids[:, None] == ids[None, :]
                        got[own] = -np.inf
                        if kinds > k:
                            low = got - off if kinds == len(ids) else np.maximum.reduceat((got - off)[:, by_id], starts, axis=1)  # the best of each id
                            floor[d][t] = np.maximum(floor[d][t], np.partition(low, kinds - k, axis=1)[:, kinds - k])
                        qi, ri = np.nonzero((got + off >= floor[d][t][:, None]) & ~own)
                        for j in range(0, len(qi), _PAIRS):
                            a, r = qi[j : j + _PAIRS], ri[j : j + _PAIRS]
                            s = cosine(qx[a], rows[r])
                            for q, v, c in _firsts(a, r, s, ids, k):
                                h = heaps[(int(qids[q]))]
                                item = (c, -v)
                                if old := next((x for x in h if x[1] == -v), None):
                                    if item > old:  # the id keeps its one place
                                        h[h.index(old)] = item
                                        heapq.heapify(h)
                                elif len(h) < k:
                                    heapq.heappush(h, item)
                                elif item > h[0]:
                                    heapq.heapreplace(h, item)
                                if len(h) == k:
                                    floor[d][t][q] = max(floor[d][t][q], h[0][0] - 1e-12)
        rows = [(q, -v, s) for q, h in heaps.items() for s, v in h]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _firsts(a, r, s, ids, k):
    """Each query's k best pairs with distinct ids, best first; an id repeated counts with its best score."""
    o = np.lexsort((-s, ids[r], a))
    a, v, s = a[o], ids[r[o]], s[o]
    one = np.concatenate([[True], (a[1:] != a[:-1]) | (v[1:] != v[:-1])])[: len(a)]
    a, v, s = a[one], v[one], s[one]
    o = np.lexsort((v, -s, a))
    a, v, s = a[o], v[o], s[o]
    new = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    for i in np.flatnonzero(place < k):
        yield int(a[i]), int(v[i]), float(s[i])


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of largest cosine, ties to the smaller id; fewer rows: all.

    A row with the query's own id is no candidate of it. Null ids, null vectors, zero vectors and such as hold null or
    non-finite components take no part; vectors of different lengths are never compared. Rows repeated with one id
    count once, with their best score. Other columns are ignored. Empty tables give an empty table.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    pick = lambda df: df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    one = materialise(pick(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-(one.agg(F.sum(F.size("v"))).first()[0] or 0) * 5 // (4 * BLOCK)))  # hashing leaves blocks uneven
    found = None
    for i in range(blocks):
        got = one.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").toArrow()
        held = {}
        if got.num_rows:
            col = got.column("v").combine_chunks()
            col = col if isinstance(col, pa.Array) else col.chunk(0)
            ids = got.column("vec_id").to_numpy()
            held = {d: (ids[at], x) for d, (at, x) in vectors(col).items()}
        shared = sc.broadcast(held)
        part = pick(rows).mapInArrow(_search(shared, k), "query_id bigint, vec_id bigint, score double")
        if blocks > 1:  # before the next block is read
            part = materialise(part)
            shared.destroy()
        found = part if found is None else found.union(part)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return best.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's search of ``embeddings``: queries are the rows whose vec_id 50 divides."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 50 = 0"))


ORACLE = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS score
  FROM e q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND len(q.v) = len(e.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
