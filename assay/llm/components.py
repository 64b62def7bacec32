"""Connected components by breadth-first search from many seeds at once.

Adjacency lists are rows hash-partitioned by node. Seeds are the nodes whose
hash is below that of all their neighbours, so every component has one and they
lie apart. Each round joins the frontier with the adjacency; a node adopts the
label of least hash that reaches it. Where two searches meet, their labels are an
edge of a small graph of labels, on which the same is done again until no two
labels meet. The hash stays the same throughout, so the middle of a star, which
adopted the least of its seeds, is the one seed of the star its labels form.
Every step is a distributed join or aggregation; no nodes, links or labels are
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def _place(column: str) -> Column:
    return F.struct(F.xxhash64(column).alias("h"), F.col(column).alias("v"))


def _search(arcs: DataFrame) -> DataFrame:
    """(node, label) for every node of arcs (src, dst), both directions given; labels of one component may still differ."""
    around = arcs.groupBy("src").agg(F.min(_place("dst")).alias("least"))
    frontier = cut(around.where(_place("src") < F.col("least")).select(F.col("src").alias("node"), F.col("src").alias("label")), "seeds")
    reached, before = frontier, None
    while True:
        near = frontier.join(arcs, frontier.node == arcs.src).groupBy(F.col("dst").alias("node")).agg(F.min(_place("label")).alias("l"))
        # a neighbour of the frontier that was reached earlier was so in this round or the one before: no older ones need be read
        known = frontier.select("node") if before is None else frontier.select("node").unionByName(before.select("node"))
        before, frontier = frontier, cut(near.join(known, "node", "left_anti").select("node", F.col("l.v").alias("label")), "frontier")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the least node of each node's component; strings compare by their bytes.

    Null ends and links of a node with itself bind nothing, and give no row. Repeated links count once. No links, no rows.
    """
    plain = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null and src <> dst")
    arcs = cut(plain.union(plain.select("dst", "src")).distinct(), "arcs")
    if arcs.isEmpty():
        return arcs.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    labels = _search(arcs)
    left, right = labels.select(F.col("node").alias("src"), F.col("label").alias("la")), labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    collisions = cut(arcs.join(left, "src").join(right, "dst").where("la < lb").select("la", "lb").distinct(), "collisions")
    if not collisions.isEmpty():
        merged = components(collisions, "la", "lb")
        labels = labels.join(merged.select(F.col("node").alias("label"), F.col("component").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return cut(labels.join(least, "label").select("node", "component"), "components")
