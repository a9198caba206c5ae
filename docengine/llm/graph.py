"""Connected components of a graph held in DataFrames: contraction in rounds, nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.staging import staged

JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of `edges` (a, b), the smallest node reachable. Loops and nulls are ignored.

    In each round every node hooks onto its smallest neighbour if that is smaller, the hooks are followed to their ends'
    ends (JUMPS times), and the edges are rewritten between what is left; a round at least halves the nodes of a connected
    part in practice, and the loop ends when no edge is left. A hot node only meets sums and splittable joins.
    """
    clean = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = staged(clean(edges))
    labels = None
    while not live.isEmpty():
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to"))
        hooks = staged(hooks)
        for _ in range(JUMPS):
            onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("end"))
            hooks = staged(hooks.join(onward, "to").select("node", F.col("end").alias("to")))
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("component"))
        else:
            step = hooks.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = staged(labels)
        ends = lambda c: hooks.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        live = staged(clean(live.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))))
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("component"))
