"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification.

A document is its five-word shingles (a text of fewer words is one shingle), each of weight 1, or with
weighted=True of the number of times that it occurs. Each shingle's points arrive as a Poisson process
of its weight, every point at a random register; a register keeps its first arrival's shingle. A shingle stops
as soon as its next arrival is later than all registers. Two signatures agree at a register with
the probability Jaccard of the weights, the measure that is verified: for equal weights it is the Jaccard of the sets.

Contents that share one of `bands` bands of `rows` registers are candidates (30 bands of 5: a
pair at 0.8 is missed with a probability below 1e-5). A pair is linked when that measure, worked out
exactly, is at least `threshold`; classes are the components of the links.

No pairs become rows. Equal word sequences are one content. Candidate components come from the
stars around each band's smallest member; they are dealt into blocks of at most
`block_shingles` shingles, and a block verifies its pairs in memory, skipping those already linked.
A component of several blocks adds about `pivots` hashed members to each of its blocks to connect
them, and then everything outside its largest class meets every block, so that no pair with
a common band stays unverified unless it is already in one class.

Defined cases: null texts and texts without words are alone; a null id is alone, with a null class;
rows that repeat an id are one document, compared by the smallest of its texts that have candidates; an empty table gives an empty result; columns that clash
with the output's are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintfield.llm.common import WordHashes, discard, given_back, mix64, settled, text_batches
from glintfield.llm.components import connected_components

GOLDEN = 0x9E3779B97F4A7C15
_HASHES = WordHashes()


def _shingle_pool(token_lists: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, shingle hash) of every shingle, documents in order."""
    counts = np.array([len(t) for t in token_lists], np.int64)
    tokens = _HASHES.of([w for t in token_lists for w in t])
    doc = np.repeat(np.arange(len(token_lists)), counts)
    hashed = tokens.copy()
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    rest = np.repeat(counts, counts) - place
    for k in range(1, width):
        there = np.flatnonzero(rest > k)
        hashed[there] = mix64(hashed[there] * np.uint64(GOLDEN) + tokens[there + k])
    whole = (rest >= width) | (place == 0)
    return doc[whole], mix64(hashed[whole])


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of one whole text."""
    return np.unique(_shingle_pool([(text or "").encode().split()], width)[1])


Weights = tuple[np.ndarray, np.ndarray]


def weighted_shingles(text: str | None, width: int = 5) -> Weights:
    """The sorted distinct shingle hashes and how often each occurs."""
    hashes, counts = np.unique(_shingle_pool([(text or "").encode().split()], width)[1], return_counts=True)
    return hashes, counts.astype(float)


def probability_jaccard(a: Weights, b: Weights) -> float:
    """Sum over common shingles i of 1 / sum over all j of max(x_j / x_i, y_j / y_i).

    Which of the two is larger depends on whether y_j / x_j is beyond y_i / x_i, so sums along that ratio give all of them.
    """
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    ratio = np.divide(y, x, out=np.full(len(x), np.inf), where=x > 0)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    upto, beyond = np.append(0, np.cumsum(x)), y.sum() - np.append(0, np.cumsum(y))
    both = (x > 0) & (y > 0)
    last = np.searchsorted(ratio, ratio[both], side="right")
    return float((1 / (upto[last] / x[both] + beyond[last] / y[both])).sum())


def signatures(token_lists: list[list[bytes]], registers: int, width: int = 5, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash signatures (a row a document) and distinct shingle counts."""
    n = len(token_lists)
    doc, pool = _shingle_pool(token_lists, width)
    order = np.lexsort((pool, doc))
    doc, pool = doc[order], pool[order]
    first = np.ones(len(pool), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (pool[1:] != pool[:-1])
    weight = np.diff(np.flatnonzero(first), append=len(first)).astype(float) if weighted else np.ones(int(first.sum()))
    doc, pool = doc[first], pool[first]
    sizes = np.bincount(doc, minlength=n)
    best, owner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    arrival = np.zeros(len(pool))
    point = 0
    while len(pool):
        point += 1
        draw = mix64(pool + np.uint64(point * GOLDEN & (1 << 64) - 1))
        arrival = arrival - np.log1p(-((draw >> np.uint64(11)) * 2.0**-53)) / weight
        at = doc * registers + (mix64(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, at, arrival)
        won = best[at] == arrival
        owner[at[won]] = pool[won]
        active = arrival < best.reshape(n, registers).max(1)[doc]
        doc, pool, arrival, weight = doc[active], pool[active], arrival[active], weight[active]
    return owner.reshape(n, registers), sizes


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band, the band's number mixed in."""
    parts = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(parts.shape[2]):
        key = mix64(key * np.uint64(GOLDEN) + parts[:, :, k])
    return key.astype(np.int64)


SKETCH = pa.struct([("content", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketches(texts: pa.Array, bands: int, rows: int, width: int, weighted: bool) -> pa.Array:
    """The sketches of a batch, made for some hundred texts or 50,000 words at a time."""
    out, here, words = [], [], 0

    def flush():
        signature, sizes = signatures(here, bands * rows, width, weighted)
        keys = band_keys(signature, bands)
        out.extend((xxhash.xxh3_128_digest(b" ".join(t)), int(n), k.tolist()) if n else (None, 0, []) for t, n, k in zip(here, sizes, keys))
        here.clear()

    for text in texts:
        here.append((text.as_py() or "").encode().split())
        words += len(here[-1])
        if words > 50_000 or len(here) >= 300:
            flush()
            words = 0
    if here:
        flush()
    _done()
    columns = list(zip(*out)) or [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SKETCH)], [f.name for f in SKETCH])


def _done() -> None:
    """Between groups and batches a worker keeps no words and no free memory."""
    _HASHES.clear()
    given_back()


class Classes:
    """Union-find over the rows of one group; the smallest node is the root."""

    def __init__(self, nodes: list[int]):
        self.up = {n: n for n in nodes}

    def root(self, n: int) -> int:
        while self.up[n] != n:
            self.up[n] = n = self.up[self.up[n]]
        return n

    def link(self, a: int, b: int) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def _verify(left: list[int], right: list[int] | None, sets: dict[int, np.ndarray] | dict[int, Weights], keys: dict[int, np.ndarray], classes: Classes, threshold: float, label: dict[int, int]) -> None:
    """Links all pairs of left (or of left and right) that share a band and reach the threshold."""
    k_left = np.stack([keys[n] for n in left])
    k_right = k_left if right is None else np.stack([keys[n] for n in right])
    other = left if right is None else right
    shared = np.zeros((len(left), len(other)), np.int16)
    for band in range(k_left.shape[1]):
        shared += k_left[:, band, None] == k_right[None, :, band]
    if right is None:
        shared = np.triu(shared, 1)
    i, j = np.nonzero(shared)
    for p in np.argsort(-shared[i, j], kind="stable"):
        a, b = left[i[p]], other[j[p]]
        if a == b or classes.root(label.get(a, a)) == classes.root(label.get(b, b)):
            continue
        x, y = sets[a], sets[b]
        if isinstance(x, tuple):
            if probability_jaccard(x, y) >= threshold - 1e-9:
                classes.link(label.get(a, a), label.get(b, b))
            continue
        if min(len(x), len(y)) < threshold * max(len(x), len(y)):
            continue
        both = np.intersect1d(x, y, assume_unique=True).size
        if both >= threshold * (len(x) + len(y) - both) - 1e-9:
            classes.link(label.get(a, a), label.get(b, b))


LINKS = pa.schema([("owner", pa.int64()), ("node", pa.int64()), ("root", pa.int64())])


def near_duplicate_classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 30, rows: int = 5, block_shingles: int = 200_000, block_rows: int = 400, pivots: int = 48, broadcast_rows: int = 50_000, weighted: bool = False) -> DataFrame:
    """Per row of df: the id, class_id (the smallest id of its class) and n_shingles."""

    pool = weighted_shingles if weighted else shingles

    @F.arrow_udf("struct<content: binary, n: bigint, bands: array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        return _sketches(texts, bands, rows, width, weighted)

    with text_batches(df.sparkSession):
        seen = settled(df.select(F.col(id_col).alias("id"), sketch(F.col(text_col)).alias("s")).select("id", "s.*"))
    nodes = seen.where("n > 0 AND id IS NOT NULL").groupBy("content").agg(F.min("id").cast("long").alias("node"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    nodes = settled(nodes)
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "hub")
    stars = settled(keyed.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    comps = connected_components(stars).select("node", F.col("label").alias("comp"))

    # Blocks: small components share a batch, a large one has blocks of its own.
    sized = comps.join(nodes.select("node", "n", "bands"), "node")
    per = sized.groupBy("comp").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("m"))
    blocks_of = F.greatest(F.ceil(F.col("all_n") / block_shingles), F.ceil(F.col("m") / block_rows)).cast("int")
    placed = settled(sized.join(per.select("comp", "m", blocks_of.alias("blocks")), "comp"))
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    batches = max(1, total[0] // block_shingles, total[1] // block_rows)
    known = F.broadcast(placed) if total[1] <= broadcast_rows else placed
    texts = df.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(known, "node")

    def local(key: tuple, table: pa.Table) -> pa.Table:
        rows = zip(*(table[x].to_pylist() for x in ("node", "comp", "text", "bands")))
        own = {n: (c, t, b) for n, c, t, b in sorted(rows, key=lambda r: (r[0], r[2] or "", r[3]), reverse=True)}  # the smallest text of an id
        owner, out = key[0].as_py(), []
        members: dict[int, list[int]] = {}
        for n in sorted(own):
            members.setdefault(own[n][0], []).append(n)
        for comp, group in members.items():
            classes = Classes(group)
            _verify(group, None, {n: pool(own[n][1], width) for n in group}, {n: np.array(own[n][2]) for n in group}, classes, threshold, {})
            out += [(owner, n, classes.root(n)) for n in group]
        _done()
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out)], schema=LINKS)

    whole = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(batches)))
    spot = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks").cast("long"))
    is_pivot = F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("m")) < pivots
    every_block = F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)
    where = F.explode(F.when(F.col("blocks") == 1, F.array(whole)).when(is_pivot, every_block).otherwise(F.array(spot)))
    dealt = texts.select("node", "comp", "text", "bands", "blocks", where.alias("block"), F.when(F.col("blocks") > 1, F.col("comp")).otherwise(F.lit(-1)).alias("owner"))
    links = settled(dealt.groupBy("owner", "block").applyInArrow(local, "owner bigint, node bigint, root bigint"))

    # Components of one block are done.
    labels = links.where("owner < 0").select("node", F.col("root").alias("label"))
    large = placed.where("blocks > 1").select("node", "comp", "blocks", "m")
    if not large.isEmpty():
        labels = labels.unionByName(_finish_large(links.where("owner >= 0"), large, texts, block_rows, width, threshold, pool))
    found = nodes.select("node", "content").join(labels, "node", "left").select("content", F.coalesce("label", "node").alias("label"))
    smallest = F.coalesce(F.col("label"), F.col("id").cast("long"))
    classes = settled(seen.join(found, "content", "left").select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), smallest).alias("class_id"), F.col("n").alias("n_shingles")))
    discard(seen, nodes, stars, comps, placed, links)
    return classes


def _finish_large(links: DataFrame, large: DataFrame, texts: DataFrame, block_rows: int, width: int, threshold: float, pool) -> DataFrame:
    """Labels of the nodes of large components, once the blocks of each have met."""
    first = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    tagged = large.join(first, "node")
    # The largest class of each component; the rest of the component meets all its blocks.
    sizes = settled(tagged.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("k")))
    main = sizes.groupBy("comp").agg(F.max_by("label", F.struct("k", "label")).alias("main"), (F.sum("k") - F.max("k")).alias("rest"))
    tagged = settled(tagged.join(main, "comp"))
    chunks = F.greatest(F.ceil(F.col("rest") / block_rows), F.lit(1)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    spread = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    rows = texts.select("node", "text", "bands").join(tagged.where("rest > 0"), "node").select("node", "text", "bands", "comp", "label", "main", chunks.alias("chunks"), F.col("blocks").cast("long").alias("blocks"))
    base = rows.select("node", "text", "bands", "label", "comp", spread(F.col("blocks"), "block").alias("block"), every(F.col("chunks")).alias("chunk"))
    odd = rows.where("label <> main").select("node", "text", "bands", "label", "comp", spread(F.col("chunks"), "chunk").alias("chunk"), every(F.col("blocks")).alias("block"))
    odd = odd.toDF(*odd.columns)  # attributes of its own, beside base in one cogroup

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return LINKS.empty_table()
        label, sets, keys = {}, {}, {}
        for t in (left, right):
            for n, lab, text, b in sorted(zip(*(t[x].to_pylist() for x in ("node", "label", "text", "bands"))), key=lambda r: (r[0], r[2] or "", r[3])):
                label[n] = lab
                if n not in sets:
                    sets[n], keys[n] = pool(text, width), np.array(b)
        classes = Classes(list(set(label.values())))
        _verify(sorted(set(left["node"].to_pylist())), sorted(set(right["node"].to_pylist())), sets, keys, classes, threshold, label)
        out = [(0, n, classes.root(n)) for n in classes.up if classes.root(n) != n]
        _done()
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], schema=LINKS)

    late = odd.groupBy("comp", "block", "chunk").cogroup(base.groupBy("comp", "block", "chunk")).applyInArrow(meet, "owner bigint, node bigint, root bigint")
    late = settled(late.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    merged = connected_components(late.union(first.select(F.col("node").alias("a"), F.col("label").alias("b"))).distinct())
    discard(first, sizes, tagged, late)
    return merged.select("node", "label")


def keep_one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = 500_000, **options) -> DataFrame:
    """df with one row of each near-duplicate class, that of the smallest id. Rows with a null id stay.

    The ids that go (and ids that repeat) meet the rows by broadcast while they are at most `broadcast_ids`
    (8 bytes each), so that texts are not shuffled; beyond that by a shuffle join.
    """
    classes = near_duplicate_classes(df, id_col=id_col, text_col=text_col, **options)
    stays = F.max((F.col(id_col).cast("long") == F.col("class_id")).cast("int"))
    ids = settled(classes.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(stays.alias("stays"), F.count(F.lit(1)).alias("times")))
    discard(classes)
    kept, again = _without(df, ids.where("stays = 0").select(id_col), id_col, broadcast_ids), ids.where("stays = 1 AND times > 1").select(id_col)
    if again.isEmpty():
        return kept
    one = kept.join(again, id_col, "left_semi").dropDuplicates([id_col])
    return _without(kept, again, id_col, broadcast_ids).unionByName(one)


def _without(df: DataFrame, ids: DataFrame, id_col: str, broadcast_ids: int) -> DataFrame:
    return df.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, id_col, "left_anti")
