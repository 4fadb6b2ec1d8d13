"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node with an edge; label: least node reachable.

    ``edges`` has long columns a and b.  Each round every node takes its least
    neighbour as parent, parents are followed three steps, and edges are drawn
    anew between what they lead to; edges inside a component vanish.  The rounds
    grow with the logarithm of the nodes; each is staged, so lost executors cost
    a round at most.
    """
    spark = edges.sparkSession
    left = stage(edges.select("a", "b").where("a <> b"), "edges")
    rounds = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        up = stage(up, "parents")
        jump = up
        for _ in range(2):
            nxt = jump.select(F.col("a").alias("q"), F.col("p").alias("r"))
            jump = jump.join(nxt, F.col("p") == F.col("q"), "left").select("a", F.coalesce("r", "p").alias("p"))
        jump = stage(jump, "parents")
        rounds.append(jump)
        x = left.join(jump.select("a", F.col("p").alias("x")), "a").select("b", "x")
        y = x.join(jump.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
        left = stage(y.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components did not converge")
    if not rounds:
        return spark.createDataFrame([], "node long, label long")
    out = rounds[0].select(F.col("a").alias("node"), F.col("p").alias("label"))
    for r in rounds[1:]:
        out = out.join(r.select(F.col("a").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
    return out
