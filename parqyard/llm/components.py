"""Connected components of an edge table, with DataFrame operations only and nothing collected but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); label is the smallest node reachable.

    Each round hooks the label of one end of an edge to the smaller one of the other, follows the hooks to their end
    and drops edges whose ends agree; rounds grow with the logarithm of a component's diameter. Every join has a
    written table on both sides, so that Spark can split the rows of a hot node.
    """
    live = write_table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = write_table(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    while True:
        la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        # edges between labels: those that agree vanish, parallel ones become one
        ends = live.join(la, "a").join(lb, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        between = write_table(ends.distinct(), "edges")
        drop_table(live)
        live = between
        hooks = write_table(live.groupBy("b").agg(F.min("a").alias("to")), "hooks")
        if hooks.isEmpty():
            drop_table(hooks)
            drop_table(live)
            return labels
        while True:  # a hook's end may hook on
            far = hooks.select(F.col("b").alias("to"), F.col("to").alias("end"))
            step = write_table(hooks.join(far, "to", "left").select("b", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")), "hooks")
            moved = not step.filter("moved").isEmpty()
            drop_table(hooks)
            hooks = step.select("b", "to")
            hooks._scratch_path = step._scratch_path
            if not moved:
                break
        new = labels.join(hooks.select(F.col("b").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        new = write_table(new, "labels")
        drop_table(labels)
        drop_table(hooks)
        labels = new
