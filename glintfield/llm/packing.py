"""Best-fit packing of documents into bins of `capacity` tokens, with conflicts.

Pieces (documents, or parts of those longer than a bin) are dealt into shards of about
`shard_pieces` and packed there, longest first. A shard's open bins are ordered by
residual; each carries bitmaps of its sources (one for every repetition up to `per_source`) and of
its duplicate clusters. The search starts at the tightest bin that can hold the piece and
goes on to successors until a bin has no conflict; if none has, a bin is opened.

No bin holds two pieces of different documents of one cluster, or more than `per_source`
documents of one source. A document longer than a bin fills bins of its own with whole parts,
and its rest is packed like a document.

Defined cases: null and empty texts have no tokens, no bin (bin_id null) and length 0; a null source
or cluster conflicts with nothing; rows that repeat an id are packed like different documents of
their clusters; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintfield.llm.common import settled

PACKED = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bin", pa.int64()), ("slot", pa.int32())])


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, slot) of each piece; pieces come in the order in which they are packed."""
    repeated = {c for c in clusters if c is not None}
    cluster_bit = {c: 1 << k for k, c in enumerate(sorted(x for x, m in _counts(clusters).items() if m > 1 and x in repeated))}
    source_bit = {s: 1 << k for k, s in enumerate(sorted({x for x in sources if x is not None}))}
    open_bins: list[tuple[int, int]] = []  # (residual, bin), rising
    of_sources: list[list[int]] = []
    of_clusters: list[int] = []
    filled: list[int] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (of_sources[open_bins[at][1]][-1] & s or of_clusters[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(filled)
            of_sources.append([0] * per_source)
            of_clusters.append(0)
            filled.append(0)
        full = of_sources[b]
        for level in range(per_source):
            if not full[level] & s:
                full[level] |= s
                break
        of_clusters[b] |= c
        out.append((b, filled[b]))
        filled[b] += 1
        if residual > length:
            insort(open_bins, (residual - length, b))
    return out


def _counts(values: list) -> dict:
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    return counts


def pack(df: DataFrame, *, id_col: str = "doc_id", length_col: str = "n_tokens", source_col: str = "source", cluster_col: str = "cluster", capacity: int = 2048, per_source: int = 2, shard_pieces: int = 4096) -> DataFrame:
    """Per piece: id, piece_start, piece_tokens, bin_id, slot (from 0). source_col: text; cluster_col: integers."""
    counted = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("long").alias("cluster"), F.rand(11).alias("at"))
    # Settled before it is counted and dealt: lengths are worked out once, and a task that runs again finds every piece in its shard.
    rows = settled(counted)
    total = rows.agg(F.coalesce(F.sum(F.ceil(F.greatest("n", F.lit(0)) / capacity)), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_pieces))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long")))
    pieces = rows.where("n > 0").select("*", starts.alias("start"))
    shard = F.pmod(F.xxhash64("at", "start"), F.lit(shards)).cast("int")
    full = pieces.select("doc", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).alias("length"), "source", "cluster", shard.alias("shard"))

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc", "ascending"), ("start", "ascending")])
        placed = best_fit(table["length"].to_pylist(), table["source"].to_pylist(), table["cluster"].to_pylist(), capacity, per_source)
        bins, slots = np.array(placed, np.int64).reshape(-1, 2).T
        return pa.table([table["doc"], table["start"], table["length"], pa.array((key[0].as_py() << 32) + bins), pa.array(slots.astype(np.int32))], schema=PACKED)

    packed = full.groupBy("shard").applyInArrow(fill, "doc bigint, start bigint, length bigint, bin bigint, slot int")
    none = [F.lit(0).cast("long").alias(x) for x in ("start", "length")]
    empty = rows.where("n <= 0").select("doc", *none, F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("slot"))
    return packed.unionByName(empty).select(F.col("doc").alias(id_col), F.col("start").alias("piece_start"), F.col("length").alias("piece_tokens"), F.col("bin").alias("bin_id"), "slot")
