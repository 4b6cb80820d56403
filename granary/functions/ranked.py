"""Global row numbers and running sums without a single-partition window.

Rows are range-partitioned and sorted; each partition's count (and sum) becomes an offset for the
partitions after it. Only one small row per partition reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.staging import staged

_SHIFT = 33  # monotonically_increasing_id() holds the partition above the row's place in it


def with_global_order(df: DataFrame, order: list[Column], rn: str = "rn", running: dict[str, str] | None = None) -> DataFrame:
    """Adds ``rn`` (from 1, in ``order``) and, for each ``running[name] = column``, the inclusive
    running sum of ``column`` in that order. ``order`` must identify a row up to ties that do not matter."""
    running = running or {}
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed.withColumn("_part", F.shiftright("_at", _SHIFT)), "ordered")
    sums = [F.sum(c).alias(f"_s_{name}") for name, c in running.items()]
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), *sums)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *[F.sum(f"_s_{n}").over(before).alias(f"_before_{n}") for n in running])
    local = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"_local_{n}": F.sum(c).over(local) for n, c in running.items()}) if running else placed
    out = out.join(F.broadcast(offsets), "_part")
    out = out.withColumn(rn, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _SHIFT) - 1)) + 1)
    for n in running:
        out = out.withColumn(n, F.col(f"_local_{n}") + F.coalesce(f"_before_{n}", F.lit(0).cast("decimal(38,2)")))
    return out.drop("_at", "_part", "_before", *[f"_before_{n}" for n in running], *[f"_local_{n}" for n in running])
