"""Scans within keys (running sums, last value so far, next value) where one key may hold most of the rows.

A window by key puts a key's rows into one task. Here rows are range-partitioned by key and order, so a large key is cut
into several parts of the usual size; each part is scanned by itself, and what its key's earlier (or, for the next value, later) parts amount
to is added. Only keys that lie on both sides of a cut need that, one row for each part and such key: at most
two rows a partition, which is what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.staging import staged

_SHIFT = 33  # monotonically_increasing_id() holds the partition above the row's place in it


def segmented(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, nexts: dict[str, str] | None = None) -> DataFrame:
    """Adds, within each key and in ``order``: ``sums`` {new: column} inclusive running sums, ``lasts`` the column's last value that is
    not null up to the row, ``nexts`` its value in the row after (null in the last). ``order`` must identify a row up to ties that do not matter.
    Null keys are keys like others. The column ``part`` says which part a row was scanned in."""
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumns({"part": F.shiftright("_at", _SHIFT), "_key": F.struct(*keys)})
    placed = staged(placed, "segments")
    ends = placed.groupBy("part").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"))
    either = ends.select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_c"))
    cut = either.groupBy("_c").agg(F.count("*").alias("n")).where("n > 1").select("_c")
    spread = placed.join(F.broadcast(cut), F.col("_key") == F.col("_c"), "left_semi")  # two keys a partition at most
    held = spread.groupBy(F.col("part").alias("_p"), F.col("_key").alias("_c")).agg(
        F.count("*").alias("_n"),
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_l_{n}") for n, c in lasts.items()],
        *[F.min_by(F.struct(c), F.col("_at")).getField(c).alias(f"_x_{n}") for n, c in nexts.items()],
    )
    parts = Window.partitionBy("_c").orderBy("_p")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(
        "_p",
        "_c",
        *[F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in lasts],
        *[F.lead(f"_x_{n}").over(parts).alias(f"_x_{n}") for n in nexts],
    )
    own = Window.partitionBy("part", "_key").orderBy("_at")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns(
        {f"_o_s_{n}": F.sum(c).over(upto) for n, c in sums.items()}
        | {f"_o_l_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
        | {f"_o_x_{n}": F.lead(c).over(own) for n, c in nexts.items()}
        | ({"_end": F.lead(F.lit(1)).over(own).isNull()} if nexts else {})
    )
    out = local.join(F.broadcast(carried), (F.col("part") == F.col("_p")) & (F.col("_key") == F.col("_c")), "left")
    for n in sums:
        kind = local.schema[f"_o_s_{n}"].dataType
        out = out.withColumn(n, F.col(f"_o_s_{n}") + F.coalesce(f"_s_{n}", F.lit(0).cast(kind)))
    for n in lasts:
        out = out.withColumn(n, F.coalesce(f"_o_l_{n}", f"_l_{n}"))
    for n in nexts:
        out = out.withColumn(n, F.when(F.col("_end"), F.col(f"_x_{n}")).otherwise(F.col(f"_o_x_{n}")))
    return out.select(*df.columns, "part", *sums, *lasts, *nexts)
