"""Walks over ordered events whose users may have any number of them: scans in range partitions.

Events are dealt by ranges of (group, order). Each range folds its part of a group to one row; these rows, as many as a
group has ranges, give every range its start; then each range walks its own events. No task needs a whole group.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintfield.session import discard, settled


def in_ranges(events: DataFrame, group: str, order: list[str]) -> DataFrame:
    """events, settled, with the number `part` of the range that each is in; ranges follow (group, order)."""
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(events.repartitionByRange(parts, group, *order).withColumn("part", F.spark_partition_id()))


def running_sum(events: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """events with the sum of value over their group up to and with each one, in the order given (a total one)."""
    dealt = in_ranges(events.withColumn("_v", value), group, order)
    within = Window.partitionBy("part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(group, "part").agg(F.sum("_v").alias("_t")).select(group, "part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_ahead"))
    summed = dealt.withColumn("_s", F.sum("_v").over(within)).join(totals, [group, "part"])
    return summed.withColumn(name, F.coalesce("_s", F.lit(0)) + F.col("_ahead")).drop("_v", "_s", "_t", "_ahead", "part")


#: f(v) = min(high, max(low, v + add)): what any run of clamped steps and resets amounts to.
Clamped = tuple[float, float, float]


def then(f: Clamped, g: Clamped) -> Clamped:
    """g after f."""
    inside = lambda v: min(g[2], max(g[1], v + g[0]))
    return f[0] + g[0], inside(f[1]), inside(f[2])


def applied(f: Clamped, v: float) -> float:
    return min(f[2], max(f[1], v + f[0]))


def wheel_steps(delta: Column) -> Column:
    """Steps of a wheel's turn: multiples of 120, half ones to even; any smaller turn is a step."""
    steps = F.bround(delta / 120.0).cast("int")
    return F.when(steps == 0, F.signum(delta).cast("int")).otherwise(steps)


def bounded_walk(events: DataFrame, group: str, order: list[str], *, start: float, low: float, high: float, reset: float | None = None) -> DataFrame:
    """events(group, order..., move) with value, each group's bounded value after the event, and changed.

    A move is added and the sum held in [low, high]; a null move sets the value to `reset` (default: start), unheld.
    The value begins at `start` held in the bounds. `order` names columns that order a group's events totally.
    """
    anew = start if reset is None else reset
    begin = min(high, max(low, start))
    dealt = in_ranges(events.drop("value", "changed"), group, order)
    keys = [(name, "ascending") for name in order]

    def moves(table: pa.Table) -> list[Clamped]:
        return [(0.0, anew, anew) if m is None else (m, low, high) for m in table["move"].to_pylist()]

    def total(key: tuple, table: pa.Table) -> pa.Table:
        whole: Clamped = (0.0, float("-inf"), float("inf"))
        for m in moves(table.sort_by(keys)):
            whole = then(whole, m)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([key[1].as_py()], table[group].type), **{n: [x] for n, x in zip(("add", "low", "high"), whole)}})

    def carry(key: tuple, table: pa.Table) -> pa.Table:
        v, out = begin, []
        for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
            out.append((row["part"], v))
            v = applied((row["add"], row["low"], row["high"]), v)
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "g": pa.array([key[0].as_py()] * len(out), table["g"].type), "begin": [x for _, x in out]})

    def walk(key: tuple, table: pa.Table, begins: pa.Table) -> pa.Table:
        table = table.sort_by(keys)
        v, values, changed = begins["begin"][0].as_py(), [], []
        for m in moves(table):
            old, v = v, applied(m, v)
            values.append(v)
            changed.append(v != old)
        return table.append_column("value", pa.array(values, pa.float64())).append_column("changed", pa.array(changed))

    kind = dealt.schema[group].dataType.simpleString()
    narrow = dealt.select("part", group, "move", *order)
    totals = narrow.groupBy("part", group).applyInArrow(total, f"part int, g {kind}, add double, low double, high double")
    begins = totals.groupBy("g").applyInArrow(carry, f"part int, g {kind}, begin double")
    schema = T.StructType([*dealt.schema.fields, T.StructField("value", T.DoubleType()), T.StructField("changed", T.BooleanType())])
    return dealt.groupBy("part", group).cogroup(begins.groupBy("part", "g")).applyInArrow(walk, schema).drop("part")


def _rooted(nodes: DataFrame) -> DataFrame:
    """nodes with `top`, the parent if it is there."""
    ids = nodes.select(F.col("id").alias("parent")).distinct()
    return nodes.join(ids.withColumn("there", F.lit(True)), "parent", "left").withColumn("top", F.when(F.col("there"), F.col("parent"))).drop("there")


def _climbed(state: DataFrame, up: dict[str, Callable[[Column, Column], Column]], down: tuple[str, ...] = (), *, most_depth: int) -> list[DataFrame]:
    """state(id, top, ...) after each round of a climb to the roots, as settled tables; the first is the state itself.

    In the end the columns of `up` are merged, as merge(own, above), over the nodes from id up to its root, those of `down`
    summed over the nodes below and id, and `levels` counts the way to the root. Steps double: after round k a row's top is
    the node 2**k levels above, so a tree of depth d takes log2(d) rounds. A ring, or more than `most_depth` levels, is an error.
    """
    up = {**up, "levels": lambda own, above: own + above}
    rounds = [settled(state.select("id", "top", F.lit(1).cast("long").alias("levels"), *(n for n in up if n != "levels"), *down))]
    while True:
        state = rounds[-1]
        going = state.where("top IS NOT NULL")
        if going.isEmpty():
            return rounds
        above = state.select(F.col("id").alias("top"), F.col("top").alias("next"), *(F.col(n).alias(f"_{n}") for n in up))
        risen = going.join(above, "top").select("id", F.col("next").alias("top"), *(merge(F.col(n), F.col(f"_{n}")).alias(n) for n, merge in up.items()), *down)
        # Rows at their root wait aside: as nulls of the join they would all be in one task.
        joined = risen.unionByName(state.where("top IS NULL"))
        if down:
            below = going.groupBy(F.col("top").alias("id")).agg(*(F.sum(n).alias(f"_{n}") for n in down))
            joined = joined.join(below, "id", "left").select("id", "top", *up, *((F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in down))
        rounds.append(settled(joined))
        if not rounds[-1].where(F.col("levels") > most_depth).isEmpty():
            raise ValueError(f"a ring, or more than {most_depth} levels")


def tree_paths(nodes: DataFrame, *, most_depth: int = 100_000) -> DataFrame:
    """nodes(id, parent, ordinal, ...) with `path`: (ordinal, id) from the root down to the node.

    A parent that is not there makes a root; a ring, or more than `most_depth` levels, is an error. Paths are as long as
    the tree is deep; what needs only some of them does better without, as selected_layers does.
    """
    start = _rooted(nodes).select("id", "top", F.array(F.struct("ordinal", "id")).alias("path"))
    *passed, state = _climbed(start, {"path": lambda own, above: F.concat(above, own)}, most_depth=most_depth)
    discard(*passed)
    return nodes.join(state.select("id", "path"), "id")


def selected_layers(nodes: DataFrame, selection: DataFrame, *, most_depth: int = 100_000) -> DataFrame:
    """The layers that a selection of tree nodes implies: (layer, seq, path), each layer once.

    nodes(id, parent, ordinal, layer): groups have no layer. selection(seq, id) in its order, a seq an id. A selected group stands for
    all layers below it, in pre-order (siblings of one ordinal by id); a layer counts where it is seen first. Ordered by
    (seq, path) the result is in the reference order; path holds the ordinals from below the selected node down.

    Rows keep their size whatever the depth: a node's first selected ancestor comes from one climb, its number in pre-order
    from two more (sizes of subtrees, then what lies before it), and only the node that a layer is seen at gets its path.
    """
    add = lambda own, above: own + above
    # Rows that repeat an id under its parent count once, where they come first.
    once = nodes.where("id IS NOT NULL").groupBy("id", "parent").agg(F.min("ordinal").alias("ordinal"))
    if not once.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("a node under several parents")
    start = _rooted(once).join(selection.groupBy("id").agg(F.min("seq").alias("seq")), "id", "left")
    *passed, first = _climbed(start, {"seq": lambda own, above: F.least(own, above)}, most_depth=most_depth)
    placed = nodes.where("layer IS NOT NULL").select("id", "layer").join(first.where("seq IS NOT NULL").select("id", "seq"), "id")
    wins = settled(placed.groupBy("layer").agg(F.min("seq").alias("seq")))
    # Between a layer's node and the selected one that shows it first, every node has that one as its first: cut elsewhere.
    shown = first.select("id", "seq").join(wins.select("seq").distinct(), "seq", "left_semi")
    kept = settled(once.join(shown, "id"))
    seen = settled(placed.join(wins, ["layer", "seq"]).select("layer", "seq", "id"))
    discard(*passed, first)
    over = kept.select(F.col("id").alias("parent"), "seq", F.col("id").alias("top"))
    trees = kept.join(over, ["parent", "seq"], "left")
    *passed, sized = _climbed(trees.withColumn("size", F.lit(1).cast("long")), {}, ("size",), most_depth=most_depth)
    siblings = trees.where("top IS NOT NULL").select("id", "top", "ordinal").join(sized.select("id", "size"), "id")
    ahead = running_sum(siblings, "top", ["ordinal", "id"], F.col("size"), "upto").select("id", "top", (F.col("upto") - F.col("size") + 1).alias("at"))
    roots = trees.where("top IS NULL").select("id", "top", F.lit(0).cast("long").alias("at"))
    rounds = _climbed(ahead.unionByName(roots), {"at": add}, most_depth=most_depth)
    discard(*passed, sized)
    way = seen.join(rounds[-1].select("id", "at"), "id").groupBy("layer", "seq").agg(F.min_by("id", "at").alias("id"))
    # The ways up, one node a row: the furthest tops there are, then from all nodes met so far those half as far, down to the parents.
    # These joins run in one plan, so none of them may hold a table of all nodes: small files would be broadcast, all at once.
    for step in reversed(rounds[:-1]):
        way = way.join(step.select("id", "top").hint("merge"), "id").select("layer", "seq", F.explode(F.array("id", "top")).alias("id")).where("id IS NOT NULL")
    steps = way.join(rounds[-1].select("id", "levels"), "id").join(kept.select("id", "ordinal"), "id")
    below = F.array_sort(F.collect_list(F.when(F.col("levels") > 1, F.struct("levels", "ordinal"))))
    return steps.groupBy("layer", "seq").agg(below.alias("path")).select("layer", "seq", F.transform("path", lambda s: s["ordinal"]).alias("path"))


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float], *, bins: int = 1024) -> DataFrame:
    """A row a group with the interpolated quantiles of value, by name; groups of any size, nulls left out.

    Each wanted rank keeps the range of values that holds it. A round counts the values of that range in `bins` equal bins (combined
    before the shuffle) and goes on with the one bin that has the rank, until one value is left.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q"), F.lit(side).alias("side")) for k, q in shares.items() for side in (0, 1))))
    place = F.col("q") * (F.col("n") - 1)
    rank = F.least(F.floor(place) + F.col("side"), F.col("n") - 1)
    first = sizes.select("g", "n", "low", "high", asked.alias("a")).select("g", "n", "low", "high", "a.*")
    targets = settled(first.select("g", "name", "side", (place - F.floor(place)).alias("part"), rank.alias("rank"), "low", "high"))
    while not targets.where("low < high").isEmpty():
        open_ones = targets.where("low < high").select("g", "name", "side", "low", "high", "rank")
        inside = rows.join(open_ones, "g").where("v >= low AND v <= high")
        width = F.col("high") / bins - F.col("low") / bins
        spot = F.when(width > 0, F.least(F.floor(F.col("v") / width - F.col("low") / width), F.lit(bins - 1))).otherwise(F.when(F.col("v") > F.col("low"), 1).otherwise(0))
        # Even where the bins are too fine for doubles, the smallest value stands alone, so every round gets on.
        spot = F.when(F.col("v") == F.col("low"), -1).otherwise(spot)
        counted = inside.groupBy("g", "name", "side", "rank", spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        order = Window.partitionBy("g", "name", "side").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counted.withColumn("upto", F.sum("n").over(order))
        found = ranked.where("rank < upto AND rank >= upto - n").select("g", "name", "side", F.col("low").alias("l"), F.col("high").alias("h"), (F.col("rank") - (F.col("upto") - F.col("n"))).alias("r"))
        targets = settled(targets.join(found, ["g", "name", "side"], "left").select("g", "name", "side", "part", F.coalesce("r", "rank").alias("rank"), F.coalesce("l", "low").alias("low"), F.coalesce("h", "high").alias("high")))
    ends = targets.groupBy("g", "name", "part").agg(F.min("low").alias("a"), F.max("low").alias("b")).withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return ends.groupBy(F.col("g").alias(group)).agg(*(F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in shares))


