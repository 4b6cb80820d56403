"""Vendors whose names are spelled almost alike, by a prefix-filtered join on q-grams.

A vendor key's q-grams are ordered from rare to frequent among all keys. Two keys whose q-gram sets have a Jaccard similarity of at least
``percent`` share at least o = ceil(percent |s| / 100) grams of each set s, so the first j grams that they share (j up to o) lie among the first
|s| - o + j of both. Keys are joined on combinations of j grams in that order: on single grams first; a combination that more than HOT keys
have is no join key but is extended by each later gram of the prefix for j + 1. There are few different q-grams however many keys there are, so
this goes on until combinations are rare, and the keys that meet on one don't grow with the table. No pair is lost: what a pair shares first is
either rare enough to join on or extended by what it shares next, for both keys alike; a combination of all o grams is joined on
however frequent. A pair that meets is dropped at once if, with what lies behind its last common gram, it can't share enough.
Candidates are compared once, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.groups import groups
from granary.functions.staging import staged, unstage
from granary.operators.suppliers import vendor_key

HOT = 100  # keys that may meet on one combination of grams


def grams(key: Column, q: int) -> Column:
    """The different q-grams of a key with q - 1 marks before and after it."""
    mark = "\x01" * (q - 1)
    padded = F.concat(F.lit(mark), key, F.lit(mark))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) + q - 1), lambda i: F.substring(padded, i, F.lit(q))))


def similar_keys(keys: DataFrame, percent: int = 60, q: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b, shared, either): all pairs a < b of different values of the column ``key`` with 100 * shared >= percent * either."""
    base = keys.where("key is not null and key != ''").select("key").distinct().withColumn("grams", grams(F.col("key"), q))
    long = staged(base.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram")), "grams")
    often = long.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("df"))
    counted = long.join(often, F.col("gram") == F.col("g"))
    # Sets are as small as names are long; sorted, their beginnings are the rare grams.
    sets = counted.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("sorted"))
    sets = staged(sets, "sets")
    o = F.ceil(F.col("n") * percent / 100).cast("int")
    # (key, n, o, grams, at, combo): the gram at place ``at`` is the combination's last.
    level = sets.select("key", "n", o.alias("o"), F.transform("sorted", lambda s: s["gram"]).alias("grams"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("combo"))
    met, spent, j = None, [], 0
    while True:
        j += 1
        later = F.sequence(F.col("at") + 1, F.col("n") - F.col("o") + j)
        level = level.where(F.col("o") >= j).where(F.col("at") < F.col("n") - F.col("o") + j).withColumn("at", F.explode(later))
        # Combinations are told by a hash; two that are one by chance only add candidates.
        level = staged(level.withColumn("combo", F.xxhash64("combo", F.get("grams", F.col("at") - 1))), "combinations")
        spent.append(level)
        if level.isEmpty():
            break
        frequent = staged(level.groupBy(F.col("combo").alias("c")).agg(F.count("*").alias("keys")).where(F.col("keys") > hot).select("c"), "frequent")
        spent.append(frequent)
        joined = level.join(frequent, F.col("combo") == F.col("c"), "left")
        posts = joined.where(F.col("c").isNull() | (F.col("o") == j)).select("key", "n", "at", "combo")
        # A key that ends here meets those that go on, too, so those post on frequent combinations where such keys are.
        ends = joined.where(F.col("c").isNotNull() & (F.col("o") == j)).select(F.col("combo").alias("e")).distinct()
        more = joined.where(F.col("c").isNotNull() & (F.col("o") > j)).join(ends, F.col("combo") == F.col("e"), "left_semi").select("key", "n", "at", "combo")
        posts = staged(posts.union(more), "posts")
        spent.append(posts)
        left, right = (posts.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("at").alias(f"at{k}"), "combo") for k in ("a", "b"))
        most = j + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
        fits = (F.col("a") < F.col("b")) & (most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
        found = staged(left.join(right, "combo").where(fits).select("a", "b").distinct(), "met")
        spent.append(found)
        met = found if met is None else met.union(found)
        level = level.join(frequent, F.col("combo") == F.col("c"), "left_semi")
    met = sets.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0) if met is None else met.distinct()
    names = sets.select("key", F.transform("sorted", lambda s: s["gram"]).alias("grams"))
    both = met.join(names.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a").join(names.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    out = both.select("a", "b", shared.alias("shared"), (F.size("ga") + F.size("gb") - shared).alias("either"))
    out = staged(out.where(F.col("shared") * 100 >= F.col("either") * percent), "similar")
    for table in (long, sets, *spent):
        unstage(table)
    return out


def fuzzy_vendors(vendors: DataFrame, name: str = "vendor_name", percent: int = 60, q: int = 2, hot: int = HOT) -> DataFrame:
    """Adds vendor_key, group_key (the smallest key that similar keys lead to) and canonical_name (the group's smallest spelling).
    A null name stays, without any of them; names without letters or digits are keys of their own, compared like others."""
    keyed = vendors.withColumn("vendor_key", vendor_key(F.col(name)))
    found = groups(similar_keys(keyed.select(F.col("vendor_key").alias("key")), percent, q, hot))
    grouped = keyed.join(found.select(F.col("node").alias("vendor_key"), F.col("label").alias("group_key")), "vendor_key", "left")
    grouped = grouped.withColumn("group_key", F.coalesce("group_key", "vendor_key"))
    names = grouped.groupBy(F.col("group_key").alias("g")).agg(F.min(name).alias("canonical_name"))
    return grouped.join(names, F.col("group_key") == F.col("g"), "left").drop("g")
