"""Spend in all combinations of its dimensions, and sketches that months can be added up from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL_BITS = 12  # standard error of a count of different values: 1.04 / sqrt(2 ** 12), 1.6 per cent
KLL_K = 800  # error of a quantile's rank: some 0.4 per cent


def spend_cube(lines: DataFrame, dimensions: list[str]) -> DataFrame:
    """Spend, quantity and lines by every subset of the dimensions: one Expand, one aggregate. ``level`` has a bit for each
    dimension, the first the highest, set where it is summed over; so a null that is a value differs from a subtotal."""
    sums = lines.cube(*dimensions).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("amount").cast("decimal(38,2)").alias("spend"), F.sum("qty").cast("decimal(38,3)").alias("qty"), F.count("*").alias("n_lines")
    )
    return sums.select(*dimensions, "level", "spend", "qty", "n_lines")


def vendor_sketches(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_items, skus, lead_times): a HyperLogLog sketch of the items' skus and a KLL sketch of their lead times for each group. Sketches are
    a few kilobytes whatever they have seen; they are what is stored, rows are not needed any more."""
    return items.groupBy(*by).agg(F.count("*").alias("n_items"), F.hll_sketch_agg("sku", HLL_BITS).alias("skus"), F.kll_sketch_agg_double(F.col("lead_time_days"), KLL_K).alias("lead_times"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger groups, out of those of smaller ones."""
    return sketches.groupBy(*by).agg(F.sum("n_items").alias("n_items"), F.hll_union_agg("skus").alias("skus"), F.kll_merge_agg_double("lead_times").alias("lead_times"))


def told(sketches: DataFrame) -> DataFrame:
    """What the sketches say: the number of different skus and the quartiles of lead times, within the errors above."""
    q = {n: F.kll_sketch_get_quantile_double("lead_times", F.lit(r)) for n, r in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    return sketches.withColumns({"n_skus": F.hll_sketch_estimate("skus"), **q}).drop("skus", "lead_times")
