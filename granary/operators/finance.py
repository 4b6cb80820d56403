"""Decimal value totals, Pareto shares and ABC classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.ranked import with_global_order
from granary.functions.staging import staged
from granary.params import Params


def value_by_sku(pov: DataFrame) -> DataFrame:
    return pov.groupBy("sku").agg(F.sum("amount").cast("decimal(28,2)").alias("value"), F.sum("qty").cast("decimal(28,3)").alias("qty"), F.count("*").alias("n_lines"))


def pareto(values: DataFrame) -> DataFrame:
    """Items by falling value with their running total and share: range-partitioned, no single-partition window."""
    values = staged(values, "values")  # one row an item, read three times
    total = values.agg(F.sum("value").cast("decimal(38,2)").alias("total"))  # one row
    ranked = with_global_order(values, [F.desc("value"), F.col("sku")], rn="rank", running={"running": "value"})
    joined = ranked.crossJoin(F.broadcast(total))
    return joined.withColumn("running", F.col("running").cast("decimal(38,2)")).withColumn("cumulative_share", F.round(F.col("running").cast("double") / F.col("total").cast("double"), 8))


def abc_class(values: DataFrame, p: Params = Params()) -> DataFrame:
    """Class by running share: exact, since decimals are multiplied and never divided. The thresholds are assumed."""
    x = F.col("running") * 100
    label = F.when(x <= F.col("total") * p.abc_a, "A").when(x <= F.col("total") * p.abc_b, "B").otherwise("C")
    return pareto(values).withColumn("abc", label)


def abc_distribution(classes: DataFrame) -> DataFrame:
    return classes.groupBy("abc").agg(F.count("*").alias("n_skus"), F.sum("value").cast("decimal(38,2)").alias("value"))
