"""Connected components of a graph given as edges, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintfield.llm.common import discard, settled


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each component, for all nodes of edges(a, b).

    First every node is tied to its smallest neighbour alone, and its other smaller neighbours to that
    one, which leaves about an edge a node where many share few hubs. Each round then takes the
    smallest label among the neighbours and then the label's own label, so a component of diameter d
    is done after about log2(d) rounds. Labels are settled between
    rounds. Hot nodes only meet in joins that adaptive execution splits and in minima that are
    combined before their shuffle.
    """
    falling = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = falling.groupBy("a").agg(F.min("b").alias("m"))
    tied = falling.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    few = settled(tied.distinct())
    both = settled(few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.select("node", "label").join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        last, labels = labels, settled(lower.join(own, "label").select("node", "was", F.least("label", "up").alias("label")))
        discard(last)
        if labels.where("label <> was").isEmpty():
            discard(few, both)
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
