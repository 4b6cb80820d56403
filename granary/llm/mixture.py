"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target number of words. A document's place is a hash of its id and text; a source takes every
document whose hash lies below its threshold. The threshold is found by histograms: words summed by
source and hash bucket, the bucket that crosses the budget found by a running sum over at most 4,096
buckets a source, and only that bucket refined by the next 12 hash bits, down to single hash values.
Nothing is sorted, and raising a target only adds documents (thresholds nest).

Edge cases: null and empty texts count 0 words; a null source is a source of its own; rows alike in id and text share
their hash, so they are taken together; a very long text is one document like any other, so a source may miss its target
by half of its longest one; an empty table gives an empty result; other columns pass through whatever their names,
but those named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.ranked import with_global_order
from granary.functions.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 3


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: str, text: str) -> Column:
    """36 bits of the MD5 of id and text: the same in any engine and on every run."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target) from (source, size). Sources weigh ``weights`` in turn, by code
    point, null last. They share ``share`` times all words by weight; no target exceeds ``most`` times its
    source's size, the excess going to the others by weight until none is above."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = with_global_order(by, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    by = staged(by.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "sources")
    total, weight_sum = by.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, left, over = share * (total or 0), None, weight_sum or 0, 0.0
    while left and (rate := (budget - over) / left) != level:  # scalars only; the rate rises until no source is above
        level = rate
        over, left = by.agg(F.coalesce(F.sum(F.when(F.col("cap") < F.col("weight") * level, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("cap") >= F.col("weight") * level, F.col("weight"))), F.lit(0))).first()
    target = F.least(F.col("cap"), F.col("weight") * F.lit(float(level or 0.0)))
    return by.select("source", "source_size", "weight", target.alias("target"))


def thresholds(base: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): every document is taken ``whole`` times and once more if
    its place is less than ``below``. base: (source, size, place); goal: targets()."""
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    open_ = staged(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")), "budgets")
    out = open_.select("source", "source_size", "target", "whole", "rest", "prefix")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        now = F.col("place").bitwiseAND(F.lit(-1 << (shift + BITS)))
        rows = base.select("source", "size", now.alias("prefix"), F.shiftright("place", shift).alias("bucket"))
        near = out.where("prefix is not null").select(F.col("source").alias("s"), F.col("prefix").alias("p"), "rest")
        hist = rows.join(near, rows.source.eqNullSafe(near.s) & (rows.prefix == near.p)).groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", upto)
        # The first bucket that reaches the budget is the boundary; those before it are in.
        cross = hist.where("upto >= rest and upto - n < rest").select(F.col("source").alias("s"), F.shiftleft("bucket", shift).alias("b"), (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"), "n")
        joined = out.join(cross, out.source.eqNullSafe(cross.s), "left")
        if level == LEVELS - 1:  # a single hash value: in if that comes nearer
            below = F.when(F.col("b").isNull(), F.coalesce(F.col("prefix"), F.lit(0))).when(F.col("n") - F.col("left") < F.col("left"), F.col("b") + 1).otherwise(F.col("b"))
            return staged(joined.select("source", "source_size", "target", "whole", below.alias("below")), "thresholds")
        out = staged(joined.select("source", "source_size", "target", "whole", F.coalesce("left", "rest").alias("rest"), F.col("b").alias("prefix")), "budgets")
    raise AssertionError


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents with size, source_size, target and copies (how often the mix takes each), as columns
    that start with ``mix_``."""
    added = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    names = [c for c in docs.columns if c not in added]
    own = {c: f"c{i}" for i, c in enumerate(names)}
    docs = docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in names])  # so no name can clash
    placed = docs.withColumns({"size": word_count(own["text"]), "place": place(own["doc_id"], own["text"])})
    base = staged(placed.select(F.col(own["source"]).alias("source"), "size", "place"), "sizes")
    limits = thresholds(base, targets(base, weights, share, most))
    copies = F.col("whole") + (F.col("place") < F.col("below")).cast("long")
    joined = placed.join(limits, F.col(own["source"]).eqNullSafe(limits["source"]))
    return joined.select(*own.values(), "size", "source_size", "target", copies.alias("copies")).toDF(*names, *added)
