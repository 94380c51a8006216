"""Connected components of an edge table, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import cut_lineage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node that ``edges`` (a, b) reach from a node, for every node that has one.

    Each round a node takes the smallest root among its neighbours' roots, its old root learns of it
    too (whole trees hook onto the smaller one), and then jumps to its new root's root.  Rounds
    follow the logarithm of the longest chain; each writes its table.  Joins go by node; the last
    one of a round, by root, brings only the roots that have just moved, so a component of any size
    meets a handful of rows there.
    """
    both = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
                       .union(edges.select("b", "a")).where("u <> v").distinct(), f"{name}_edges", drop_shuffles=True)
    roots = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")).withColumnRenamed("u", "node"),
                        f"{name}_roots", drop_shuffles=True)
    while True:
        offered = both.join(roots, both.v == roots.node).groupBy("u").agg(F.min("root").alias("offer"))
        met = roots.join(offered, roots.node == offered.u).select(
            "node", "root", F.least("root", "offer").alias("new"))
        hooks = met.where("new < root").groupBy(F.col("root").alias("h")).agg(F.min("new").alias("hook"))
        pulled = met.join(hooks, met.node == hooks.h, "left").select(
            "node", "root", F.least("new", F.coalesce("hook", "new")).alias("new"))
        pulled = cut_lineage(pulled, f"{name}_pulled", drop_shuffles=True)
        moved = pulled.where("new < node").select(F.col("node").alias("p"), F.col("new").alias("grand"))
        moved = moved.join(pulled.select(F.col("new").alias("p")).distinct(), "p")      # only those that are roots
        after = cut_lineage(pulled.join(moved, pulled.new == moved.p, "left").select(
            "node", "root", F.coalesce("grand", "new").alias("new")), f"{name}_roots", drop_shuffles=True)
        roots = after.select("node", F.col("new").alias("root"))
        if after.where("new <> root").isEmpty():
            return roots
