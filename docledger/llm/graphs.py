"""Connected components of an edge table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import free, materialize


def components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 100) -> DataFrame:
    """node and root (the least node of its component) of every node of an edge; edges may repeat, either way round.

    Each round gives a node the least label of its neighbours, then the label of its label (pointer jumping), so that
    rounds grow with the logarithm of a component's diameter. A hub's neighbours are only ever reduced by a partial
    minimum. No edges give no rows; edges with a null end are left out.
    """
    both = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null and a <> b")
    both = materialize(both.union(both.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hop = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("to"))
        jump = hop.join(labels.select(F.col("node").alias("to"), F.col("root").alias("over")), "to")
        new = materialize(jump.select("node", F.least("to", "over").alias("root"), (F.least("to", "over") < F.col("was")).alias("moved")), "labels")
        moved = not new.where("moved").isEmpty()
        free(labels)
        labels = new.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
