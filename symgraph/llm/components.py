"""Connected components of an edge table by contraction, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import written

_JUMPS = 3


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``edges(src, dst)``; a component is its smallest node.

    Every round maps each node to its smallest neighbour, follows that pointer a few steps,
    and replaces the edges by those between what is left, so at least half of the nodes that
    still have neighbours go in each round. Minima are pre-aggregated before the shuffle and
    hot nodes meet only small pointer tables, so a star of any size is harmless.
    """
    live = written(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct(), "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        step = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("to")).select(F.col("src").alias("id"), "to")
        step = written(step, "step")
        for _ in range(_JUMPS):
            ahead = step.select(F.col("id").alias("to"), F.col("to").alias("_next"))
            step = step.join(ahead, "to").select("id", F.col("_next").alias("to"))
        step = written(step, "step")
        maps.append(step)
        ends = {c: step.select(F.col("id").alias(c), F.col("to").alias(f"_{c}")) for c in ("src", "dst")}
        moved = live.join(ends["src"], "src").join(ends["dst"], "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
        live = written(moved.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    found = maps[0].select("id", F.col("to").alias("component"))
    for step in maps[1:]:
        ahead = step.select(F.col("id").alias("component"), F.col("to").alias("_next"))
        found = found.join(ahead, "component", "left").select("id", F.coalesce("_next", "component").alias("component"))
    return found
