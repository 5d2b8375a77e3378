"""Connected components over an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import drop_staged, lookup_join, stage

#: Most edges that one task contracts by itself; larger graphs are contracted over distributed tables.
TASK_EDGES = 500_000


def _contracted(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of a whole graph in one task: labels hang on the smallest neighbour's and jump to their own label's label."""
    nodes, codes = np.unique(rows[["u", "v"]].to_numpy(object).ravel(), return_inverse=True)
    u, v = codes.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return pd.DataFrame({"node": nodes, "root": nodes[label]})
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not ((up := label[label]) == label).all():
            label = up


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60, task_edges: int | None = None) -> DataFrame:
    """(node, root) for every node of `edges`; root is the smallest node of its component.

    Each round hangs larger neighbours on the smallest one (large star), then smaller ones (small star);
    the rounds needed grow with the logarithm of the longest path. Every round is two partial aggregations
    and two joins on the node, written to the shared folder, and nothing is gathered on the driver but a
    count and a checksum. The hub of a giant component is salted. A graph of `task_edges` edges or fewer (TASK_EDGES by
    default), which is counted, goes to one task instead. Null ends and self loops link nothing; nodes that only occur in self loops are
    their own root. An empty table gives an empty result.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    start = stage(raw.distinct())
    if start.count() <= (TASK_EDGES if task_edges is None else task_edges):
        kind = start.schema["u"].dataType.simpleString()
        return stage(start.repartition(1).groupBy().applyInPandas(_contracted, f"node {kind}, root {kind}"))
    raw = start
    nodes_alone = raw.where("u = v").select(F.col("u").alias("node")).distinct()
    now = stage(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup_join(both.where("v > u"), low, ["u"], "inner", row_size=64).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select("u", "v", "m")
        small = hung.select("u", F.col("m").alias("v")).union(hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = stage(small)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        drop_staged(now)
        now = new
        if before == tuple(mark):
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    rooted = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = rooted.select(F.col("root").alias("node"), F.col("root")).distinct()
    both = rooted.union(roots)
    return both.union(nodes_alone.join(both, "node", "left_anti").select("node", F.col("node").alias("root")))
