"""Connected components of an undirected graph of pairs, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: (a long, b long) -> (node, root): root is the smallest node of the component. Each round
    hooks every node to the least root among its neighbours' and follows roots once more, so the number
    of rounds grows as the logarithm of the longest path in most graphs."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "roots")
    last = roots
    for _ in range(rounds):
        near = both.join(roots.withColumnsRenamed({"node": "b", "root": "r"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        hooked = roots.join(near, "node").select("node", "root", F.least("root", "r").alias("new"))
        # the old root takes the least root that any of its nodes has found
        pulled = hooked.groupBy(F.col("root").alias("node")).agg(F.min("new").alias("p"))
        step = hooked.join(pulled, "node", "left").select("node", "root", F.least("new", "p").alias("new"))
        step = stored(step, "roots-step")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        done = stored(step.join(jump, "new").select("node", F.col("root").alias("old"), F.least("new", "far").alias("root")), "roots")
        discard(step, last)
        roots, last = done.select("node", "root"), done
        if not done.where("old <> root").take(1):
            break
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    discard(both)
    return roots
