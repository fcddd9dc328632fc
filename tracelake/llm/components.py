"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): root is the smallest node that can be reached. ``edges`` has two columns of one orderable type.

    Each round takes the smallest label among a node's neighbours (partial minima before the shuffle), then jumps
    to that label's own label, so a chain of n nodes takes about log n rounds. The label table is written to the
    shared folder each round: a hub's edges then meet one label row, a join that adaptive execution can split.
    Nodes without edges don't appear; self-loops and repeated edges change nothing; no edges give no rows.
    """
    a, b = edges.columns
    both = written(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"))))
    label = written(both.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("root")))
    for _ in range(rounds):
        near = both.join(label, both.src == label.node).groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("near"))
        lower = written(label.join(near, "node").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved")))
        if not lower.where("moved").limit(1).count():
            return lower.select("node", "root")
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
        label = written(lower.join(up, "root").select("node", F.col("above").alias("root")))
    raise RuntimeError(f"no end after {rounds} rounds")
