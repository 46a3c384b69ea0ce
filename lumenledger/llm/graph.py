"""Connected components as joins and aggregations; no part of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import fresh, materialise, release


def roots(parents: DataFrame) -> DataFrame:
    """Follow (node, parent) to the roots, which are their own parents, by doubling; pointers have no cycles."""
    before = None
    while True:
        up = parents.select(fresh(F.col("node")).alias("_up"), F.col("parent").alias("_top"))
        jumped = parents.join(up, fresh(F.col("parent")) == F.col("_up"), "left").select(
            "node", F.coalesce("_top", "parent").alias("root"), (F.coalesce("_top", "parent") != F.col("parent")).alias("_moved")
        )
        jumped = materialise(jumped, "roots")
        if before is not None:
            release(before)
        before = jumped
        if not jumped.where("_moved").limit(1).count():
            return jumped
        parents = jumped.select("node", F.col("root").alias("parent"))


def components(edges: DataFrame) -> DataFrame:
    """A written table with node and root for every node of the edges (a, b); the root is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, follows these pointers to their ends by doubling, and
    contracts the graph to the ends.  Rounds halve the nodes at least, so their number is logarithmic; each
    is a written table.
    """
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left = materialise(left, "edges")
    labels = None
    while True:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        table = roots(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least")).select("node", F.least("node", "_least").alias("parent")))
        ends = table.select("node", "root")
        top = ends.select(fresh(F.col("node")).alias("_n"), F.col("root").alias("_r"))
        done = [left, table]
        if labels is None:
            labels = table
            done = [left]
        else:
            done.append(labels)
            labels = materialise(
                labels.select("node", "root").join(top, fresh(F.col("root")) == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "labels"
            )
        again = left.join(top.withColumnRenamed("_r", "_ra"), fresh(F.col("a")) == F.col("_n")).drop("_n")
        again = again.join(top.withColumnRenamed("_r", "_rb"), fresh(F.col("b")) == F.col("_n")).where("_ra != _rb")
        left = materialise(again.select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).distinct(), "edges")
        release(*done)
        if not left.limit(1).count():
            release(left)
            return labels
