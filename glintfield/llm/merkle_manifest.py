"""A Merkle manifest of a dataset: digests of rows, of groups of rows and of the whole, with proofs.

Each row is a leaf. The leaves of one group (`tree_col`), in the order of their ids, are the bottom of
that group's tree: while several nodes remain, every `arity` consecutive ones (the last run may have
fewer, even one) become the digest of their concatenation. The groups' roots, in the order of the groups
(null first), make the tree of the whole in the same way. A leaf's proof is the siblings that it meets
on its way to the root.

Plan, for any size of table and of group:

1. Rows become digests where they are read; no text is shuffled. Positions come from range partitions (`ranked`).
2. A tree is cut into aligned blocks of arity ** block_levels nodes. A task reduces a block to its digest;
   the digests are the next layer's nodes, until each tree has one block. A layer is smaller by the size of a block.
3. Back down, each block emits its nodes' paths by fractal traversal and appends the path of the block
   itself, which came from the layer above: one short row a block, met in a cogroup.

Fractal traversal (`Traversal`): the levels of a block are stacked in subtrees of `height` levels. Of each
only the existing subtree, which the present leaf's path runs through, and the desired one, which comes
next and grows by a leaf a round, are kept: arity * levels digests of each, not the block's tree.

Defined cases: null fields count as `-`, so null and empty texts have different leaves; the group null is a
tree of its own; null ids stand first; rows of one group with one id stand in the order of their
leaves, and rows repeated whole are a leaf each, with equal columns but for their proofs; a lone leaf
is its own tree; a table of one row has an empty proof; an empty table gives an empty result; columns
that are no fields are not covered and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintfield.llm.common import discard, settled
from glintfield.llm.ranking import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row's fields: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def block_root(nodes: list[str], levels: int, arity: int) -> str:
    for _ in range(levels):
        nodes = [digest("".join(nodes[k : k + arity])) for k in range(0, len(nodes), arity)]
    return nodes[0]


class Subtree:
    """The nodes of levels low to high - 1 below node `top` of level high, built leaf by leaf."""

    def __init__(self, leaves: list[str], widths: list[int], low: int, high: int, top: int, arity: int):
        self.leaves, self.low, self.high, self.arity = leaves, low, high, arity
        self.base = [top * arity ** (high - level) for level in range(high)]
        self.ends = [min(b + arity ** (high - level), widths[level]) for level, b in enumerate(self.base)]
        self.next = list(self.base)  # the node to come, at each level
        self.runs: list[list[str]] = [[] for _ in range(high)]
        self.rows: list[list[str]] = [[] for _ in range(high)]

    def grow(self) -> bool:
        """One leaf and the runs that it completes; False if all leaves are in."""
        if self.next[0] >= self.ends[0]:
            return False
        node = self.leaves[self.next[0]]
        for level in range(self.high):
            run = self.runs[level]
            run.append(node)
            if level >= self.low:
                self.rows[level].append(node)
            self.next[level] += 1
            if len(run) < self.arity and self.next[level] < self.ends[level]:
                break
            if level + 1 < self.high:
                node = digest("".join(run))
            run.clear()
        return True

    def finished(self) -> Subtree:
        while self.grow():
            pass
        return self

    def siblings(self, level: int, node: int, width: int) -> tuple[str, str]:
        """What stands left and right of a node in its run."""
        row, base = self.rows[level], self.base[level]
        start = node - node % self.arity
        end = min(start + self.arity, width)
        return "".join(row[start - base : node - base]), "".join(row[node + 1 - base : end - base])


class Traversal:
    """The authentication paths of a block's leaves, one after another: [left, right] of each level, in one list."""

    def __init__(self, leaves: list[str], levels: int, arity: int = 8, height: int = 1):
        self.leaves, self.levels, self.arity = leaves, levels, arity
        self.widths = [-(-len(leaves) // arity**level) for level in range(levels + 1)]
        self.spans = [(low, min(low + height, levels)) for low in range(0, levels, height)]

    def _subtree(self, span: tuple[int, int], top: int) -> Subtree:
        return Subtree(self.leaves, self.widths, *span, top, self.arity)

    def paths(self) -> Iterator[list[str]]:
        exist = [self._subtree(s, 0).finished() for s in self.spans]
        desired = [self._subtree(s, 1) for s in self.spans]
        tops = [1] * len(self.spans)
        for leaf in range(len(self.leaves)):
            path: list[str] = []
            for (low, high), tree in zip(self.spans, exist):
                for level in range(low, high):
                    path += tree.siblings(level, leaf // self.arity**level, self.widths[level])
            yield path
            for k, span in enumerate(self.spans):
                if (leaf + 1) % self.arity ** span[1] == 0:
                    tops[k] += 1
                    exist[k], desired[k] = desired[k].finished(), self._subtree(span, tops[k])
                else:
                    desired[k].grow()


def fold(node: str, path: list[str]) -> str:
    """The root that a node and its siblings give."""
    for k in range(0, len(path), 2):
        node = digest(path[k] + node + path[k + 1])
    return node


def _blocks(nodes: DataFrame, size: int, arity: int, levels: int) -> DataFrame:
    """nodes(tree, first, copies, n, ...) by block: a row for each block that a node's copies reach."""
    end = F.col("first") + F.col("copies")
    reached = nodes.withColumn("block", F.explode(F.sequence(F.expr(f"first div {size}"), F.expr(f"(first + copies - 1) div {size}"))))
    height = F.lit(levels)
    for level in reversed(range(levels)):
        height = F.when(F.col("n") <= arity**level, level).otherwise(height)
    start = F.greatest(F.col("first"), F.col("block") * size)
    past = F.least(end, (F.col("block") + 1) * size)
    return reached.withColumns({"levels": height, "start": start - F.col("block") * size, "copies": past - start}).drop("first")


def _leaves(table: pa.Table) -> tuple[pa.Table, list[int]]:
    table = table.sort_by([("start", "ascending")]) if table.num_rows > 1 else table
    return table, table["copies"].to_pylist()


def _spread(values: list, copies: list[int]) -> list:
    return [v for v, k in zip(values, copies) for _ in range(k)]


def _climb(nodes: DataFrame, size: int, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The layers of blocks of all trees, settled, and the trees' roots (tree, node)."""

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        table, copies = _leaves(table)
        root = block_root(_spread(table["node"].to_pylist(), copies), table["levels"][0].as_py(), arity)
        return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "n": [table["n"][0].as_py()], "node": [root]})

    layers = []
    while True:
        layers.append(settled(_blocks(nodes, size, arity, levels)))
        reduced = layers[-1].select("tree", "block", "n", "levels", "start", "copies", "node").groupBy("tree", "block").applyInArrow(reduce, "tree string, block bigint, n bigint, node string")
        reduced = settled(reduced)
        most = reduced.agg(F.max("n")).first()[0]
        if most is None or most <= size:
            return layers, reduced.select("tree", "node")
        count = F.ceil(F.col("n") / size)
        nodes = reduced.select("tree", F.col("block").alias("first"), F.lit(1).cast("long").alias("copies"), count.alias("n"), "node")


#: What a layer hands down: the path from a block (or from a whole tree, block 0) to the root.
ABOVE = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
ABOVE_SQL = "tree string, block bigint, path array<string>, subroot string, root string"


def merkle_manifest(df: DataFrame, *, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS, found: dict[str, Column] | None = None, arity: int = 8, block_levels: int = 3, height: int = 1, proofs: bool = False) -> DataFrame:
    """Per row: the id, leaf, subroot, root, proof_sha256, folded_root and verified.

    `found` has, for a check of altered data, what fields contain now; folded_root is what such a row's leaf
    gives with the manifest's siblings, and verified whether that is the root. proofs=True adds `proof`:
    the siblings' digests left and right of the path, level by level.
    """
    size = arity**block_levels
    same = F.lit(True)
    for name, column in (found or {}).items():
        same = same & F.col(name).eqNullSafe(column)
    tree = F.coalesce(F.concat(F.lit("+"), F.col(tree_col).cast("string")), F.lit(""))  # null first, else bytewise
    now = leaf_digest([(found or {}).get(f, F.col(f)) for f in fields])
    leaves = df.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("node"), F.when(~same, now).alias("found"))
    rows = leaves.groupBy("tree", "id", "node", "found").agg(F.count(F.lit(1)).alias("copies"))
    lower, roots = _climb(ranked(rows, "tree", ["id", "node", "found"]), size, arity, block_levels)
    groups = roots.select(F.lit("all").alias("tree"), F.col("tree").alias("id"), "node", F.lit(1).cast("long").alias("copies"))
    upper, whole = _climb(ranked(groups, "tree", ["id"]), size, arity, block_levels)

    def descend(layer: DataFrame, above: DataFrame, emit, schema) -> DataFrame:
        def meet(key: tuple, table: pa.Table, over: pa.Table) -> pa.Table:
            table, copies = _leaves(table)
            walk = Traversal(_spread(table["node"].to_pylist(), copies), table["levels"][0].as_py(), arity, height)
            return emit(table, copies, walk, over.to_pylist()[0])

        return layer.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(meet, schema)

    def of_blocks(table: pa.Table, copies: list[int], walk: Traversal, over: dict) -> pa.Table:
        first = over["block"] * size
        return pa.Table.from_pylist([over | {"block": first + k, "path": p + over["path"]} for k, p in enumerate(walk.paths())], ABOVE)

    def of_groups(table: pa.Table, copies: list[int], walk: Traversal, over: dict) -> pa.Table:
        names = table["id"].to_pylist()
        return pa.Table.from_pylist([{"tree": names[k], "block": 0, "path": p + over["path"], "subroot": walk.leaves[k], "root": over["root"]} for k, p in enumerate(walk.paths())], ABOVE)

    def of_rows(table: pa.Table, copies: list[int], walk: Traversal, over: dict) -> pa.Table:
        found, beyond, out = _spread(table["found"].to_pylist(), copies), {}, []
        for leaf, altered, path in zip(walk.leaves, found, walk.paths()):
            here = fold(altered or leaf, path)
            if here not in beyond:
                beyond[here] = fold(here, over["path"])
            path = path + over["path"]
            out.append((leaf, digest("".join(path)), beyond[here], path if proofs else None))
        leaf, proof, folded, path = zip(*out)
        n = len(out)
        columns = {id_col: pa.array(_spread(table["id"].to_pylist(), copies), table["id"].type), "leaf": leaf, "subroot": [over["subroot"]] * n, "root": [over["root"]] * n, "proof_sha256": proof, "folded_root": folded, "verified": [x == over["root"] for x in folded]}
        return pa.table(columns | ({"proof": pa.array(path, pa.list_(pa.string()))} if proofs else {}))

    above = whole.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for layer in reversed(upper[1:]):
        above = settled(descend(layer, above, of_blocks, ABOVE_SQL))
    above = settled(descend(upper[0], above, of_groups, ABOVE_SQL))
    discard(*upper)
    for layer in reversed(lower[1:]):
        above = settled(descend(layer, above, of_blocks, ABOVE_SQL))
    discard(*lower[1:])
    schema = T.StructType().add(id_col, df.schema[id_col].dataType)
    for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(name, "string")
    schema = schema.add("verified", "boolean")
    return descend(lower[0], above, of_rows, schema.add("proof", T.ArrayType(T.StringType())) if proofs else schema)
