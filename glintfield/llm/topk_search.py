"""Exact top-k search by inner product, with sorted access only (no-random-access aggregation).

Vectors are dealt into blocks of about `block_rows` candidates and queries into blocks of
`query_rows`; each pair of blocks is one task's group, so neither side is ever whole anywhere. In
a group every component is a sorted list. A query reads all lists in parallel, `depth` entries a
step, from the end where its products are largest. What it has read of a candidate gives a lower
bound (unread components at the list's far end) and an upper bound (at the list's current place). Whoever cannot reach the k-th best lower bound is out, and reading stops when few are left; those
survivors' scores are then resolved exactly, and the k best of each group meet in one ranking
per query.

Candidates whose upper bound equals the k-th lower bound survive, so ties go to the smaller id.
Defined cases: vectors that are null, or hold null or non-finite components, take no part; shorter
vectors count as padded with zeros; a repeated candidate id is that many candidates, none of them for a
query of the same id; a repeated query id is asked once, with the smallest of its vectors; fewer than k candidates give fewer rows; extra columns are dropped.
Components of 2**20 or more in size after scaling are an error: their products could leave 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 1 << 20
RESULT = "query_id bigint, vec_id bigint, score bigint"
SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_vector(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    ok = embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(ok, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


class SortedLists:
    """One block of candidates, each component a list that is sorted from either end.

    A query with a positive component reads that list from its largest values down, one with
    a negative component from the smallest up. All queries of a block read at the same pace, so that
    what was read, and the bounds, are matrix products over queries and candidates.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lists = np.sort(vectors.T, axis=1)
        order = np.argsort(vectors.T, axis=1, kind="stable")
        up = np.empty(order.shape, np.int32)
        np.put_along_axis(up, order, np.arange(len(ids), dtype=np.int32)[None], 1)
        #: Place of each candidate in each list: read from the top, then read from the bottom.
        self.place = np.concatenate([len(ids) - 1 - up, up])
        self.values = np.concatenate([vectors.T, vectors.T])

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and exact scores of its k best candidates other than its own id."""
        found = []
        for row, alive in enumerate(self._survivors(query_ids, queries, k, depth)):
            scores = self.vectors[alive] @ queries[row]
            best = np.lexsort((self.ids[alive], -scores))[:k]
            found.append((self.ids[alive][best], scores[best]))
        return found

    def _survivors(self, query_ids: np.ndarray, queries: np.ndarray, k: int, depth: int) -> list[np.ndarray]:
        """For each query, who can still be among the k best when its sequential reading stops."""
        n, most = len(self.ids), int(np.abs(self.vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * queries.shape[1]
        real = np.float32 if most < 1 << 23 else np.float64  # sums of integers below 2**24 are exact in float32
        signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1).astype(real)
        values, worst = self.values.astype(real), np.concatenate([self.lists[:, 0], self.lists[:, -1]]).astype(real)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        reading, known = np.arange(len(queries)), np.zeros((len(queries), n), real)
        for at in range(0, n, depth):
            known += signed[reading] @ np.where((self.place >= at) & (self.place < at + depth), values, 0).astype(real)
            others = self.ids[None] != query_ids[reading, None]
            if at + depth >= n:
                lower = upper = known
            else:
                unread = (self.place >= at + depth).astype(real)
                here = np.concatenate([self.lists[:, n - 1 - at - depth], self.lists[:, at + depth]]).astype(real)
                lower, upper = (known + (signed[reading] * bound) @ unread for bound in (worst, here))
            ranked = np.where(others, lower, -np.inf)
            reach = np.partition(ranked, max(n - k, 0), 1)[:, max(n - k, 0)]
            stay = others & (upper >= reach[:, None])
            done = (stay.sum(1) <= max(4 * k, n // 32)) | (at + depth >= n)
            for row in np.flatnonzero(done):
                out[reading[row]] = np.flatnonzero(stay[row])
            reading, known = reading[~done], known[~done]
            if not len(reading):
                break
        return out


def exact_top_k(queries: DataFrame, candidates: DataFrame, *, id_col: str = "vec_id", vector_col: str = "vector", k: int = 5, block_rows: int = 2048, query_rows: int = 512, depth: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query.

    Both tables hold id_col (integers) and vector_col (array<bigint>, see integer_vector).
    """
    usable = [df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")) for df in (queries, candidates)]
    large = F.exists("v", lambda x: F.abs(x) >= MOST)
    usable = [df.withColumn("v", F.when(large, F.raise_error(F.concat(F.lit("a component of 2**20 or more in vector "), F.col("id").cast("string"))).cast("array<bigint>")).otherwise(F.col("v"))) for df in usable]
    asked = usable[0].groupBy("id").agg(F.min("v").alias("v"))
    # Equal rows beyond k cannot be among a query's k best; so no repeated row, however often, fills a block.
    held = usable[1].groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    held = held.select("id", "v", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    n_queries, n_candidates = asked.count(), held.count()
    q_blocks, c_blocks = -(-n_queries // query_rows) or 1, -(-n_candidates // block_rows) or 1
    spread = lambda blocks, *by: F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = asked.select("id", "v", spread(q_blocks, "id").alias("qb")).select("*", every(c_blocks).alias("cb"))
    held = held.select("id", "v", spread(c_blocks, "id", "v", "nth").alias("cb")).select("*", every(q_blocks).alias("qb"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return SCHEMA.empty_table()
        width = max(max((len(x) for x in t["v"].to_pylist()), default=0) for t in (left, right))
        lists = SortedLists(right["id"].to_numpy(), _matrix(right["v"], width))
        out = lists.top(left["id"].to_numpy(), _matrix(left["v"], width), k, depth)
        parts = [np.repeat(left["id"].to_numpy(), [len(ids) for ids, _ in out]), *(np.concatenate(x) for x in zip(*out))]
        return pa.table([pa.array(x.astype(np.int64)) for x in parts], schema=SCHEMA)

    found = asked.groupBy("qb", "cb").cogroup(held.groupBy("qb", "cb")).applyInArrow(search, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
