"""Connected components of an edge table, by least-label propagation with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.store import small, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of ``edges`` reaches.

    Each round takes the least label among a node and its neighbours and then
    the label of that label, so long chains halve; labels are written to the
    shared folder, and the driver sees only the counts of all and of changed
    rows.  Labels of a checked small number of nodes go to every task, those of
    more are joined by a shuffle.  A node's neighbours fold in a partial
    aggregation, so a star of any size is no hot group.  Null ends are left
    out; an empty table gives no rows.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = written(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = written(both.groupBy("x").agg(F.least("x", F.min("y")).alias("root")), "labels", tidy=False)
    known = small(label)
    while True:
        near = (both.join(known(label.withColumnRenamed("x", "y")), "y")
                .groupBy("x").agg(F.min("root").alias("near")))
        step = near.join(known(label), "x").select("x", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("x").alias("root"), F.col("root").alias("far"))
        step = (step.join(known(jump), "root", "left")
                .select("x", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        after = written(step, "labels", tidy=False)
        label = after.drop("old")
        if not after.where("root <> old").limit(1).count():
            return label.withColumnRenamed("x", "node")
