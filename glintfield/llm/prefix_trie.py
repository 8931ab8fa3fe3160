"""The trie of conversation prefixes, as a Patricia tree of the sorted conversations.

A node is a distinct sequence of first turns; its members are the conversations that start with it.
Conversations become keys of 16 bytes a turn (a digest of role and text) with the turns' word counts; equal keys
are one sequence with its copies. Then:

1. The sequences are sorted and dealt by ranges of their keys, so a first turn that a third of them share
   is spread over tasks.
2. Each range builds its part of the tree with a stack, from the common prefixes of neighbours: points
   exist only where sequences branch or end, and each carries the compressed edge above it. Counts and sums are
   made on these points.
3. Nodes that several ranges share are the prefixes common to neighbours at the ranges' borders. A range
   sends what it has of them (a short list) to one merge, which walks the borders in order: as many
   rows as ranges, whatever the number of conversations.
4. Each range gets the merged values of its borders back, builds its points again, and expands the edges'
   unary nodes: all have their lower point's members, and their saved tokens are suffix sums along the edge.

`ends_sha256` is streamed: ids sorted in ranges become joined pieces of at most `piece_ids` ids, and a
sequence's pieces pass through one running hash in their order, so no list of ids is held.

A conversation is one row of some 20 bytes a turn, as a document is one row with its text.

Defined cases: rows with a null conversation id are left out; a null turn stands first, and turns of one
number in the order of their digests (repeated rows stay as turns of their own); null role or text is
empty; a conversation without turns ends at the root; without conversations there is no node; columns
other than the four are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintfield.llm.common import discard, settled

TURN = 16  # bytes of a turn in a key
NO_ENDS = sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def conversation_turns(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digest x (hexadecimal) and word count w."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    x = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    w = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), x.alias("x"), w.alias("w")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["x"].alias("x"), t["w"].alias("w"))).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two keys have in common at their start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * TURN] == b[: mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """The points of one range of sorted distinct sequences.

    left and right: depths to which the first and the last sequence share nodes with the ranges before and
    behind (-1: none). Shared nodes' own tokens are left out of `below`; the merge adds them.
    """

    def __init__(self, keys: list[bytes], words: list[list[int]], convs: list[int], copies: list[int], left: int, right: int):
        self.m, self.left, self.right = len(keys), left, right
        self.lengths = [len(k) // TURN for k in keys]
        self.offsets = np.concatenate([[0], np.cumsum([n + 1 for n in self.lengths])])
        flat = np.concatenate([[0], *([*w, 0] for w in words)])[:-1] if words else np.zeros(1)
        # Words up to each depth, sequence by sequence, from 0 at the root.
        self.sums = np.cumsum(flat.astype(np.int64))
        self.sums -= np.repeat(self.sums[self.offsets[:-1]], np.diff(self.offsets))
        self.depth, self.top, self.up, self.first, self.last = [], [], [], [], []
        self.n, self.conv, self.children, self.leaves, self.below, self.end = [], [], [], [], [], []
        stack = [self._point(0, 0)]
        for i, key in enumerate(keys):
            shared = common_turns(keys[i - 1], key) if i else 0
            self._close(stack, shared, i - 1)
            if self.lengths[i] > self.depth[stack[-1]]:
                stack.append(self._point(self.lengths[i], i))
            here = stack[-1]
            self.end[here], self.n[here], self.conv[here] = i, copies[i], convs[i]
        self._close(stack, 0, self.m - 1)
        self._attach(stack.pop(), -1, self.m - 1)

    def _point(self, depth: int, first: int) -> int:
        for column, value in ((self.depth, depth), (self.top, -1), (self.up, -1), (self.first, first), (self.last, first), (self.n, 0), (self.conv, None), (self.children, 0), (self.leaves, 0), (self.below, 0), (self.end, -1)):
            column.append(value)
        return len(self.depth) - 1

    def _close(self, stack: list[int], shared: int, last: int) -> None:
        """Takes the points deeper than `shared` off the stack; a branch point stands there afterwards."""
        while self.depth[stack[-1]] > shared:
            v = stack.pop()
            if self.depth[stack[-1]] < shared:
                stack.append(self._point(shared, self.first[v]))
            self._attach(v, stack[-1], last)

    def limit(self, v: int) -> int:
        """The greatest depth at which v's edge is shared with another range."""
        return max(self.left if self.first[v] == 0 else -1, self.right if self.last[v] == self.m - 1 else -1)

    def edge_sum(self, v: int, above: int) -> int:
        """Words of v's sequence below depth `above`, down to v."""
        at = self.offsets[self.first[v]]
        return int(self.sums[at + self.depth[v]] - self.sums[at + max(above, 0)])

    def own(self, v: int) -> int:
        """What the nodes on v's edge save that no other range shares."""
        above = max(self.top[v], self.limit(v))
        return (self.n[v] - 1) * self.edge_sum(v, above) if above < self.depth[v] else 0

    def _attach(self, v: int, p: int, last: int) -> None:
        self.last[v], self.up[v], self.top[v] = last, p, self.depth[p] if p >= 0 else -1
        if not self.children[v]:
            goes_on = last == self.m - 1 and self.right >= self.depth[v]  # the next range extends this sequence
            self.leaves[v] = 0 if goes_on else 1
        if p >= 0:
            self.n[p] += self.n[v]
            self.conv[p] = self.conv[v] if self.conv[p] is None else min(self.conv[p], self.conv[v])
            self.children[p] += 1
            self.leaves[p] += self.leaves[v]
            self.below[p] += self.below[v] + self.own(v)

    def border(self, first: bool) -> list[dict]:
        """What this range has of each node that its first (or last) sequence shares, from the root down."""
        deepest = self.left if first else self.right
        chain = [v for v in range(len(self.depth)) if (self.first[v] == 0 if first else self.last[v] == self.m - 1)]
        out: list[dict] = []
        for v in sorted(chain, key=self.depth.__getitem__):
            for d in range(self.top[v] + 1, min(self.depth[v], deepest) + 1):
                children = self.children[v] if d == self.depth[v] else 1
                goes_on = first and d < self.left  # that child began in an earlier range
                at = self.offsets[self.first[v]] + d
                out.append({"n": self.n[v], "conv": self.conv[v], "children": children - goes_on, "leaves": self.leaves[v], "saved": self.below[v] + self.own(v), "w": int(self.sums[at] - self.sums[at - 1]) if d else 0})
        return out

    def nodes(self, left: list[dict], right: list[dict], ends: list[str]) -> pa.Table:
        """All nodes that this range gives out; left and right: the merged values of its borders."""

        def at(v: int, d: int) -> int | None:
            """conv_id of the node at depth d of v's edge."""
            if d > self.limit(v):
                return self.conv[v]
            return (left if self.first[v] == 0 and d <= self.left else right)[d]["conv"]

        points = range(len(self.depth))
        limit = np.array([self.limit(v) for v in points])
        top, depth = np.array(self.top), np.array(self.depth)
        start = np.maximum(top, limit) + 1
        above = [None if start[v] == 0 else at(v, start[v] - 1) if start[v] > top[v] + 1 else at(self.up[v], top[v]) for v in points]
        many = np.maximum(depth - start + 1, 0)
        v = np.repeat(np.arange(len(depth)), many)
        d = start[v] + np.arange(len(v)) - np.repeat(np.cumsum(many) - many, many)
        conv, n, children, leaves, below = (np.array([x or 0 for x in c], np.int64) for c in (self.conv, self.n, self.children, self.leaves, self.below))
        flat = self.offsets[np.array(self.first)][v]
        saved = below[v] + (n[v] - 1) * (self.sums[flat + depth[v]] - self.sums[flat + np.maximum(d - 1, 0)])
        is_top, is_point = d == start[v], d == depth[v]
        parents = pa.array([above[k] if t else c for k, t, c in zip(v.tolist(), is_top.tolist(), conv[v].tolist())], pa.int64())
        stop = [ends[self.end[k]] if p and self.end[k] >= 0 else NO_ENDS for k, p in zip(v.tolist(), is_point.tolist())]
        local = [conv[v], d, parents, n[v], np.where(is_point, children[v], 1), leaves[v], saved, stop]
        # Shared nodes are given out where they begin.
        began = []
        for k in points:
            if self.last[k] == self.m - 1:
                for e in range(max(top[k] + 1, self.left + 1 if self.first[k] == 0 else 0), min(depth[k], self.right) + 1):
                    x = right[e]
                    stop = ends[self.end[k]] if e == depth[k] and self.end[k] >= 0 else NO_ENDS
                    began.append((x["conv"], e, right[e - 1]["conv"] if e else None, x["n"], x["children"], x["leaves"], x["saved"], stop))
        names, types = zip(*(c.split() for c in NODE.split(", ")))
        schema = pa.schema([(x, pa.string() if t == "string" else pa.int64()) for x, t in zip(names, types)])
        tables = [pa.table([pa.array(c, f.type) for c, f in zip(x, schema)], schema=schema) for x in (local, zip(*began) if began else [[]] * len(names))]
        return pa.concat_tables(tables)


def merge_borders(rows: list[dict]) -> list[dict]:
    """rows(part, common, left, right) in the order of the ranges, with all ranges' sums in left and right.

    `common`: turns that a range's first and last sequence share. The open nodes are those of the present border.
    """
    open_nodes: list[dict] = []

    def close(to: int) -> None:
        while len(open_nodes) > to:
            u = open_nodes.pop()
            u["own"] += (u["n"] - 1) * u["w"]
            if open_nodes:
                open_nodes[-1]["own"] += u["own"]
            u["saved"] += u["own"]

    out = []
    for row in rows:
        for node, more in zip(open_nodes, row["left"]):
            for what in ("n", "children", "leaves", "saved"):
                node[what] += more[what]
            node["conv"] = min(node["conv"], more["conv"])
        left = list(open_nodes)
        stay = min(row["common"] + 1, len(row["left"]), len(row["right"]))
        close(stay)
        open_nodes += [x | {"own": 0} for x in row["right"][stay:]]
        out.append({"part": row["part"], "left": left, "right": list(open_nodes)})
    close(0)
    return out


SHARED = pa.struct([(x, pa.int64()) for x in ("n", "conv", "children", "leaves", "saved", "w")])
SHARED_SQL = "array<struct<" + ", ".join(f"{f.name}: bigint" for f in SHARED) + ">>"
BORDERS = pa.schema([("part", pa.int32()), ("common", pa.int64()), ("left", pa.list_(SHARED)), ("right", pa.list_(SHARED))])
BORDERS_SQL = f"part int, common bigint, left {SHARED_SQL}, right {SHARED_SQL}"


def joined_digests(rows: DataFrame, key: str, value: str, piece_ids: int = 1000) -> DataFrame:
    """(key, ends_sha256): the digest of each key's values, ascending and joined by commas, streamed."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, start = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start] or i - start == piece_ids:
                    out.append((keys[start], values[start], ",".join(map(str, values[start:i]))))
                    start = i
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["key", "first", "piece"])

    def digests(batches):
        here, running, done = None, None, []
        for batch in batches:
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k == here:
                    running.update(b"," + piece.encode())
                    continue
                if here is not None:
                    done.append((here, running.hexdigest()))
                here, running = k, sha256(piece.encode())
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done)], names=[key, "ends_sha256"])
                done = []
        if here is not None:
            yield pa.record_batch([pa.array([here]), pa.array([running.hexdigest()])], names=[key, "ends_sha256"])

    dealt = rows.select(F.col(key).alias("key"), F.col(value).alias("value")).repartitionByRange(parts, "key", "value").sortWithinPartitions("key", "value")
    joined = dealt.mapInArrow(pieces, "key string, first bigint, piece string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, f"{key} string, ends_sha256 string")


def prefix_trie(convs: DataFrame, *, range_bytes: int = 4 << 20) -> DataFrame:
    """convs(conv_id, turns) as nodes: conv_id (the smallest member), depth, parent_conv_id and the node's figures.

    A range holds about `range_bytes` of keys.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["x"]), ""))
    rows = settled(convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["w"]).alias("words")).withColumn("seq", F.md5("key")))
    sizes = rows.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    ends = joined_digests(rows, "seq", "conv_id")
    distinct = settled(rows.join(sizes, ["seq", "conv_id"]).join(ends, "seq").select("key", "words", "conv_id", "copies", "ends_sha256"))
    discard(rows)
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]
    least = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = distinct.repartitionByRange(max(least, total // range_bytes), "key").withColumn("part", F.spark_partition_id())
    ranges = settled(ranges)
    discard(distinct)
    order = Window.orderBy("part")  # a row a range
    limits = ranges.groupBy("part").agg(F.min("key").alias("head"), F.max("key").alias("tail"))
    beside = limits.select("part", F.lag("tail").over(order).alias("before"), F.lead("head").over(order).alias("behind"))

    def points(table: pa.Table, left, right) -> tuple[Patricia, list[bytes], list[str]]:
        """left, right: how deep the borders are, from the first and the last key."""
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("key", "ascending")]))
        keys = table["key"].to_pylist()
        tree = Patricia(keys, table["words"].to_pylist(), table["conv_id"].to_pylist(), table["copies"].to_pylist(), left(keys[0]), right(keys[-1]))
        return tree, keys, table["ends_sha256"].to_pylist()

    def borders(key: tuple, table: pa.Table, near: pa.Table) -> pa.Table:
        before, behind = near["before"][0].as_py(), near["behind"][0].as_py()
        shared = lambda other: lambda own: -1 if other is None else common_turns(other, own)
        tree, keys, _ = points(table, shared(before), shared(behind))
        return pa.Table.from_pylist([{"part": key[0].as_py(), "common": common_turns(keys[0], keys[-1]), "left": tree.border(True), "right": tree.border(False)}], BORDERS)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist([r | {"common": 0} for r in merge_borders(rows)], BORDERS)

    def expand(key: tuple, table: pa.Table, near: pa.Table) -> pa.Table:
        left, right = near["left"][0].as_py(), near["right"][0].as_py()
        tree, _, ends = points(table, lambda _: len(left) - 1, lambda _: len(right) - 1)
        return tree.nodes(left, right, ends)

    found = ranges.groupBy("part").cogroup(beside.groupBy("part")).applyInArrow(borders, BORDERS_SQL)
    merged = settled(found.groupBy().applyInArrow(merge, BORDERS_SQL))
    return ranges.groupBy("part").cogroup(merged.groupBy("part")).applyInArrow(expand, NODE)
