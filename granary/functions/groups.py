"""Groups of linked nodes by label propagation over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged, unstage


def groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node that links lead to; nodes without a link are not in it.

    Each round every node takes the smallest label among its own and its neighbours', then the label of that label, so a chain
    halves with every round instead of shrinking by one. A hub is combined map-side. Null ends count as no link."""
    ways = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ways = ways.select(F.col(a).alias("x"), F.col(b).alias("y")).union(ways.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x != y").distinct()
    ways = staged(ways, "ways")
    labels = staged(ways.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label")), "labels")
    while True:
        of_y = labels.select(F.col("node").alias("y"), F.col("label").alias("near"))
        near = ways.join(of_y, "y").groupBy(F.col("x").alias("n")).agg(F.min("near").alias("near"))
        joined = staged(labels.join(near, F.col("node") == F.col("n")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        roots = joined.select(F.col("node").alias("r"), F.col("label").alias("root"))
        moved = staged(joined.join(roots, F.col("label") == F.col("r"), "left").select("node", F.coalesce("root", "label").alias("label"), "was"), "labels")
        still = moved.where("label != was").isEmpty()
        unstage(labels)
        unstage(joined)
        labels = moved.select("node", "label")
        labels._staged_at = moved._staged_at
        if still:
            unstage(ways)
            return labels
