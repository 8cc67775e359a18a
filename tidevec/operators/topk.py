"""Exact nearest neighbours.

Queries travel in blocks, each small enough to broadcast; the indexed rows are read once
a block, and every Arrow batch of them is compared with the whole block by matrix
products, in tiles of a thousand rows of either side. A task keeps the k best of each
query it has seen, so what is shuffled is k rows a query and task, whatever the size of the index, and what a task holds
is a block, its k best and a tile. Candidates are ranked by exactly computed distances, ties by the smaller uid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidevec.functions import vectors

#: Bytes of query vectors in a broadcast block. Every Python worker of an executor holds one, twice while it is read; a row
#: meets 15,000 queries of 64 dimensions in it, so reading the rows once a block costs little beside comparing them.
BLOCK_BYTES = 8_000_000
#: Queries and indexed rows compared at once: 8 MB of squared distances.
TILE = 1024
#: Pairs whose vectors are laid side by side at once, for exact distances.
PAIRS = 16_384
#: Squared distances from matrix products are this far off at most, relative to the norms.
SLOP = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a float64 matrix; all rows have one length."""
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError(f"vectors of dimensions {lengths.tolist()} meet")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows i of q and j of x, summed in order of the elements."""
    total = np.zeros(len(i))
    for k in range(0, len(i), PAIRS):
        part = total[k : k + PAIRS]
        for d in (q[i[k : k + PAIRS]] - x[j[k : k + PAIRS]]).T:
            part += d * d
    return np.sqrt(total)


def _best(owner: np.ndarray, dist: np.ndarray, uid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k nearest of each owner, by owner, and their ranks from 0."""
    order = np.lexsort((uid, dist, owner))
    own = owner[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return order[rank < k], rank[rank < k]


def _few_copies(uid: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of rows without those that k equal vectors with smaller uids come before: they are nobody's k nearest."""
    if len(uid) <= k:
        return np.arange(len(uid))
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * max(1, x.shape[1])))) if x.shape[1] else np.zeros(len(uid)), return_inverse=True)
    return np.sort(_best(same.ravel(), np.zeros(len(uid)), uid, k)[0])


def _blocks(queries: DataFrame) -> Iterator:
    """The queries as broadcast blocks of (ids, matrix, lists to look into), each of BLOCK_BYTES at most; one block if
    there are none. Without a column ``lists`` there are no lists."""
    lists = F.col("lists") if "lists" in queries.columns else F.lit(None).cast("array<int>")
    numbered = queries.select(F.col("uid").alias("qid"), F.col("vec").cast("array<double>").alias("q"), lists.alias("lists"))
    size = numbered.agg(F.count("*"), F.max(F.size("q")), F.max(F.coalesce(F.size("lists"), F.lit(0)))).first()
    blocks = max(1, -(-size[0] * ((size[1] or 0) + max(0, size[2] or 0) + 1) * 8 // BLOCK_BYTES))
    for b in range(blocks):
        own = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        held = own.toArrow()
        q = _matrix(held.column("q").combine_chunks()) if held.num_rows else np.zeros((0, 1))
        into = _matrix(held.column("lists").combine_chunks()).astype(np.int32) if held.num_rows and "lists" in queries.columns else None
        yield queries.sparkSession.sparkContext.broadcast((held.column("qid").to_numpy(), q, into))


def _all(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


class _Nearest:
    """The k nearest rows seen so far of every query of a block."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, exclude_self: bool):
        self.qid, self.q, self.k, self.exclude_self = qid, q, k, exclude_self
        self.norm = np.einsum("ij,ij->i", q, q)
        self.dist, self.uid, self.count = np.full((len(qid), k), np.inf), np.zeros((len(qid), k), np.int64), np.zeros(len(qid), np.int64)

    def compare(self, own: np.ndarray, uid: np.ndarray, x: np.ndarray) -> None:
        """Compare the queries at these places with rows, in tiles."""
        if x.shape[1] != self.q.shape[1]:
            raise ValueError(f"vectors of dimensions {self.q.shape[1]} and {x.shape[1]} meet")
        left = _few_copies(uid, x, self.k + self.exclude_self)
        uid, x = uid[left], x[left]
        xn, m = (x * x).sum(1), min(self.k + self.exclude_self, len(uid))
        for j in range(0, len(own), TILE):
            tile = own[j : j + TILE]
            q = self.q[tile]
            square = q @ x.T
            square *= -2
            slop = self.norm[tile, None] + xn
            square += slop
            slop += 1
            slop *= SLOP
            worst = np.where(self.count[tile] == self.k, self.dist[tile, -1], np.inf)
            square += slop
            # rows that no query's k nearest can be behind; once all have k, what they have says enough
            bound = np.partition(square, m - 1, axis=1)[:, m - 1] if np.isinf(worst).any() else np.inf
            slop *= 2
            square -= slop
            near = square <= np.minimum(bound, worst * worst * (1 + SLOP))[:, None]
            if self.exclude_self:
                near &= self.qid[tile, None] != uid
            i_q, i_x = np.nonzero(near)
            if len(i_q):
                self._keep(tile, i_q, _exact(q, x, i_q, i_x), uid[i_x])

    def _keep(self, tile: np.ndarray, owner: np.ndarray, dist: np.ndarray, uid: np.ndarray) -> None:
        """Merge found rows of a tile's queries, given by their place in it, with what those have."""
        had = np.arange(self.k) < self.count[tile, None]
        owner = np.concatenate([np.nonzero(had)[0], owner])
        dist, uid = np.concatenate([self.dist[tile][had], dist]), np.concatenate([self.uid[tile][had], uid])
        best, rank = _best(owner, dist, uid, self.k)
        at = tile[owner[best]]
        self.dist[at, rank], self.uid[at, rank] = dist[best], uid[best]
        self.count[tile] = np.bincount(owner[best], minlength=len(tile))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for j in range(0, len(self.qid), TILE):
            i, rank = np.nonzero(np.arange(self.k) < self.count[j : j + TILE, None])
            i += j
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(self.qid[i]), pa.array(self.uid[i, rank]), pa.array(self.dist[i, rank])], ["qid", "uid", "dist"])


def topk(queries: DataFrame, index: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """qid, rank (from 1), uid and dist: the k rows of index nearest to each query, both records.

    k <= 0, no queries or an empty index give no rows; an index of fewer rows gives all of them.
    exclude_self leaves out the row with the query's own uid. If queries have ``lists`` (an array of as many numbers in
    every row) and the index has ``list``, a query sees the rows of its lists only; rows of a list should lie together.
    """
    spark = index.sparkSession
    kinds = "qid bigint, uid bigint, dist double"
    if k <= 0:
        return spark.createDataFrame([], "qid bigint, rank bigint, uid bigint, dist double")
    listed = "lists" in queries.columns
    parts = []
    for shared in _blocks(queries):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q, lists = shared.value
            if not len(qid):
                return
            found = _Nearest(qid, q, k, exclude_self)
            everyone = np.arange(len(qid))
            for batch in batches:
                for i in range(0, batch.num_rows, TILE):
                    part = batch.slice(i, TILE)
                    uid, x = part.column(0).to_numpy(), _matrix(part.column(1))
                    if not listed:
                        found.compare(everyone, uid, x)
                        continue
                    own = part.column(2).to_numpy()
                    for one in np.unique(own):
                        asked, there = np.flatnonzero((lists == one).any(1)), own == one
                        found.compare(asked, uid[there], x[there])
            yield from found.batches()

        vec = F.col("vec").cast("array<double>").alias("vec")
        parts.append(index.select("uid", vec, *["list"] * listed).mapInArrow(run, kinds))
    found = _all(parts)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "uid"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("qid", "rank", "uid", "dist")


def itopk(windowed: DataFrame, query: list[float], k: int) -> DataFrame:
    """wid, rank, uid and dist: the k rows of each window nearest to one fixed query."""
    target = F.array(*[F.lit(float(x)) for x in query])
    rows = windowed.select("wid", "uid", vectors.l2(F.col("vec"), target).alias("dist"))
    rank = F.row_number().over(Window.partitionBy("wid").orderBy("dist", "uid"))
    return rows.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("wid", "rank", "uid", "dist")


def within(queries: DataFrame, index: DataFrame, threshold: float, alpha: float = vectors.ALPHA) -> DataFrame:
    """qid, uid and sim of all indexed rows at least this similar to a query. The squared distances of a batch
    from matrix products leave few pairs, whose similarities are computed exactly."""
    reach = vectors.radius(threshold, alpha)
    parts = []
    for shared in _blocks(queries):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q, _ = shared.value
            if not len(qid):
                return
            qn = np.einsum("ij,ij->i", q, q)
            for batch in batches:
                for i in range(0, batch.num_rows, TILE):
                    part = batch.slice(i, TILE)
                    uid, x = part.column(0).to_numpy(), _matrix(part.column(1))
                    if x.shape[1] != q.shape[1]:
                        raise ValueError(f"vectors of dimensions {q.shape[1]} and {x.shape[1]} meet")
                    xn = (x * x).sum(1)
                    for j in range(0, len(q), TILE):
                        square = q[j : j + TILE] @ x.T
                        square *= -2
                        norms = qn[j : j + TILE, None] + xn
                        square += norms
                        norms += 1
                        norms *= SLOP
                        square -= norms
                        i_q, i_x = np.nonzero(square <= reach * reach)
                        sim = np.exp(-alpha * _exact(q, x, i_q + j, i_x))
                        ok = sim >= threshold
                        yield pa.RecordBatch.from_arrays([pa.array(qid[i_q[ok] + j]), pa.array(uid[i_x[ok]]), pa.array(sim[ok])], ["qid", "uid", "sim"])

        parts.append(index.select("uid", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "qid bigint, uid bigint, sim double"))
    return _all(parts)


def nearest_to(index: DataFrame, vec: list[float], k: int) -> DataFrame:
    """uid and dist of the k rows nearest to one vector: a sort of k rows a task."""
    target = F.array(*[F.lit(float(x)) for x in vec])
    return index.select("uid", vectors.l2(F.col("vec"), target).alias("dist")).orderBy("dist", "uid").limit(max(0, k))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """recall: the mean over the queries of truth of the share of their k true neighbours that were found."""
    hits = truth.select("qid", "uid").distinct().join(found.select("qid", "uid").distinct().withColumn("_hit", F.lit(1)), ["qid", "uid"], "left")
    by_query = hits.groupBy("qid").agg((F.count("_hit") / F.lit(k)).alias("share"))
    return by_query.agg(F.avg("share").alias("recall"))
