"""Joins on time: the last row before each row, and rows whose spans overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.segmented import segmented


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: dict[str, str], tie: list[str] | None = None) -> DataFrame:
    """``left`` with, as {new: column}, the values of the right row of the same keys with the latest time not after the left one's
    (nulls if there is none). Among right rows of one time the one with the largest ``tie`` columns counts.

    Both sides are laid into one order of key and time and each row takes what it has last seen of the other side: one sort, no
    pairs, and a key's rows are spread over as many tasks as they need. Null keys match each other; a left row without a time has no
    match, a right row without one is none."""
    found = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    own = F.struct(*left.columns)
    rows = left.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(left_time).alias("_time"), F.lit(1).alias("_side"), own.alias("_left"),
        F.lit(None).cast(right.select(found).schema[0].dataType).alias("_right"),
        F.struct(*[F.lit(None).cast(right.schema[t].dataType).alias(t) for t in tie or []], F.lit(0).alias("_")).alias("_tie"),
    )
    others = right.where(F.col(right_time).isNotNull()).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(right_time).cast(left.schema[left_time].dataType).alias("_time"), F.lit(0).alias("_side"),
        F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), found.alias("_right"), F.struct(*(tie or []), F.lit(0).alias("_")).alias("_tie"),
    )
    both = segmented(rows.unionByName(others), [f"_k_{k}" for k in keys], [F.col("_time"), F.col("_side"), F.col("_tie")], lasts={"_seen": "_right"})
    seen = F.when(F.col("_time").isNotNull(), F.col("_seen"))
    return both.where("_side = 1").select(*[F.col("_left")[c].alias(c) for c in left.columns], *[seen[n].alias(n) for n in columns])


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 30) -> DataFrame:
    """All pairs of rows of the same keys whose spans of days [from, to) overlap; a span with null or falling ends overlaps none.

    Time is cut into bins of ``width`` days; a row is posted to each bin that its span touches and pairs meet by an equality join on keys and
    bin. A pair that shares several bins counts in the first of them, where the later of the two begins. Choose ``width`` near the usual span:
    rows are posted about 1 + span / width times. Columns of the two sides must have different names, but for the keys."""

    def posted(df: DataFrame, span: tuple[str, str], prefix: str) -> DataFrame:
        low, high = (F.unix_date(F.col(c).cast("date")) for c in span)
        some = df.withColumns({f"_{prefix}lo": low, f"_{prefix}hi": high}).where(F.col(f"_{prefix}lo") < F.col(f"_{prefix}hi"))
        bins = F.sequence(F.floor(F.col(f"_{prefix}lo") / width), F.floor((F.col(f"_{prefix}hi") - 1) / width))
        return some.withColumn("_bin", F.explode(bins))

    pairs = posted(left, left_span, "l").join(posted(right, right_span, "r"), [*keys, "_bin"])
    begins = F.greatest("_llo", "_rlo")
    pairs = pairs.where((begins < F.least("_lhi", "_rhi")) & (F.floor(begins / width) == F.col("_bin")))
    return pairs.drop("_bin", "_llo", "_lhi", "_rlo", "_rhi")
