"""One random forest for all items: binned features, trees grown level by level from histograms that Spark sums.

An item's demand is put in thousandths of its own mean, as integers, so items of any size share one model; an observation is a period's
value and the ``lags`` before it. Features are cut at quantiles of all observations. At each level one aggregate over all
observations and trees gives, for every node, feature and bin, how many observations there are and what they sum to: at most
trees x nodes x features x bins rows whatever the number of items, from which the driver picks each node's split. Sums are integers, so
the trees do not depend on partitioning. A tree weighs an observation by a Poisson number with mean 1 drawn from a hash of
both (a bootstrap without sampling); a node leaves one feature out if ``subset``.

Items with fewer than ``lags`` + 4 periods, or without demand, have no observations; their forecast is their mean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import spread, staged, unstage
from granary.params import Params

BINS = 32
POISSON = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406)  # a millionth of the chance of at most 0, 1, ... (mean 1)


def scaled(s: DataFrame) -> DataFrame:
    """(sku, y, n, total, r): r is y in thousandths of its mean, rounded down; null without demand."""
    milli = s.select("sku", "y", F.transform("y", lambda v: F.round(v * 1000)).alias("milli"))
    sums = milli.withColumns({"n": F.size("y"), "total": F.aggregate("milli", F.lit(0.0), lambda a, v: a + v)})
    r = F.when(F.col("total") > 0, F.transform("milli", lambda v: F.floor(v * F.col("n") * 1000 / F.col("total"))))
    return sums.withColumn("r", r).drop("milli")


def observations(ratios: DataFrame, lags: int) -> DataFrame:
    """(sku, i, x, target): each period's value after the ``lags`` values before it."""
    some = ratios.where((F.col("n") >= lags + 4) & F.col("r").isNotNull())
    at = some.select("sku", "r", F.explode(F.sequence(F.lit(lags), F.col("n") - 1)).alias("i"))
    return at.select("sku", "i", F.slice("r", F.col("i") - lags + 1, lags).alias("x"), F.get("r", F.col("i")).alias("target"))


def cuts(obs: DataFrame, lags: int) -> list[list[int]]:
    """Each feature's bin borders: different values at its quantiles."""
    shares = [k / BINS for k in range(1, BINS)]
    found = obs.agg(*[F.percentile_approx(F.get("x", F.lit(j)), shares, 1_000_000).alias(f"q{j}") for j in range(lags)]).first()
    return [sorted(set(q or [])) for q in found]


def _bin(x: Column, borders: list[int]) -> Column:
    """How many borders lie below x."""
    if not borders:
        return F.lit(0)
    return F.size(F.filter(_array(borders, "bigint"), lambda b: b < x))


def _array(values: list, kind: str) -> Column:
    """A list as one literal: parsed once instead of made of a call for each entry."""
    return F.expr(f"array({','.join(f'{v!r}D' if kind == 'double' else str(v) for v in values)})").cast(f"array<{kind}>")


def weight(tree: Column, seed: int, bootstrap: bool) -> Column:
    if not bootstrap:
        return F.lit(1)
    u = F.pmod(F.xxhash64("sku", "i", tree, F.lit(seed)), F.lit(1_000_000))
    out = F.lit(len(POISSON))
    for k, below in reversed(list(enumerate(POISSON))):
        out = F.when(u < below, k).otherwise(out)
    return out


def left_out(tree: int, node: int, seed: int, lags: int) -> int:
    """The feature that a node doesn't look at."""
    return (tree * 7919 + node * 104_729 + seed) % lags


def best_split(counts: dict[tuple[int, int], tuple[int, int]], features: list[int]) -> tuple[int, int] | None:
    """(feature, last bin of the left side) that lowers the squared error most; ties to the smaller feature, then bin. None if none does.

    counts: (feature, bin) to the number of observations and their sum."""
    best, chosen = 0.0, None
    for f in features:
        bins = sorted(b for g, b in counts if g == f)
        n, s = (sum(counts[f, b][k] for b in bins) for k in (0, 1))
        left_n = left_s = 0
        for b in bins[:-1]:
            left_n, left_s = left_n + counts[f, b][0], left_s + counts[f, b][1]
            right_n, right_s = n - left_n, s - left_s
            gain = float(left_s) * float(left_s) / left_n + float(right_s) * float(right_s) / right_n - float(s) * float(s) / n
            if gain > best:
                best, chosen = gain, (f, b)
    return chosen


@dataclass
class Forest:
    """Heaps of nodes, tree after tree: node 1 is a root, 2i and 2i + 1 are below i."""

    borders: list[list[int]]
    feature: list[int]  # -1 where a node isn't split
    last_left: list[int]
    value: list[float]
    trees: int
    depth: int

    @property
    def heap(self) -> int:
        return 2 << self.depth

    def below(self, tree: Column, node: Column, bins: Column) -> Column:
        """The node that an observation goes to from ``node``, itself where it ends."""
        at = tree * self.heap + node
        f = F.get(_array(self.feature, "int"), at)
        return F.when(f < 0, node).otherwise(node * 2 + (F.get(bins, f) > F.get(_array(self.last_left, "int"), at)).cast("int"))

    def placed(self, df: DataFrame) -> DataFrame:
        """Adds ``node``, where each row's tree puts its bins; a column a level, so that all of it is compiled."""
        df = df.withColumn("node", F.lit(1))
        for _ in range(self.depth):
            df = df.withColumn("node", self.below(F.col("tree"), F.col("node"), F.col("bins")))
        return df

    def predict(self, bins: Column) -> Column:
        """The mean of the trees' values."""
        values = _array(self.value, "double")
        levels = F.sequence(F.lit(0), F.lit(self.depth))

        def mean(b: Column) -> Column:
            def one(a: Column, t: Column) -> Column:
                node = F.aggregate(levels, F.lit(1), lambda node, level: F.when(level == 0, node).otherwise(self.below(t, node, b)))
                return a + F.get(values, t * self.heap + node)

            return F.aggregate(F.sequence(F.lit(0), F.lit(self.trees - 1)), F.lit(0.0), one) / self.trees

        return F.get(F.transform(F.array(bins), mean), F.lit(0))  # the bins are made once, not for each tree

    def bins(self, x: Column) -> Column:
        return F.array(*[_bin(F.get(x, F.lit(j)), b) for j, b in enumerate(self.borders)])


def grow(obs: DataFrame, lags: int, trees: int, depth: int, seed: int, bootstrap: bool = True, subset: bool = True) -> Forest | None:
    """A forest on all observations; None if there are none."""
    borders = cuts(obs, lags)
    if not any(borders) and obs.isEmpty():
        return None
    heap = 2 << depth
    forest = Forest(borders, [-1] * (trees * heap), [0] * (trees * heap), [0.0] * (trees * heap), trees, depth)
    rows = staged(obs.select("sku", "i", forest.bins(F.col("x")).alias("bins"), "target"), "observations")
    each = spread(rows).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    each = each.withColumn("w", weight(F.col("tree"), seed, bootstrap)).where("w > 0")
    for level in range(depth):
        at = forest.placed(each).select("tree", "node", "target", "w", F.posexplode("bins").alias("feature", "bin"))
        sums = at.groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("target")).alias("s"))
        nodes: dict[tuple[int, int], dict] = {}
        for r in sums.collect():  # at most trees x nodes x lags x BINS rows
            nodes.setdefault((r["tree"], r["node"]), {})[r["feature"], r["bin"]] = (r["n"], r["s"])
        for (tree, node), counts in nodes.items():
            if node < 1 << level:  # it ended above
                continue
            seen = [f for f in range(lags) if not subset or lags == 1 or f != left_out(tree, node, seed, lags)]
            if split := best_split(counts, seen):
                forest.feature[tree * heap + node], forest.last_left[tree * heap + node] = split
    leaves = forest.placed(each).groupBy("tree", "node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("target")).alias("s"))
    for r in leaves.collect():
        forest.value[r["tree"] * heap + r["node"]] = float(r["s"]) / r["n"]
    unstage(rows)
    return forest


def pooled(s: DataFrame, p: Params = Params(), train: DataFrame | None = None, bootstrap: bool = True, subset: bool = True) -> DataFrame:
    """(sku, engine, h, yhat) of every series, from a forest on all of them (or on ``train``), each step's value feeding the next."""
    forest = grow(observations(scaled(s if train is None else train), p.lags), p.lags, p.pooled_trees, p.tree_depth, p.seed, bootstrap, subset)
    ratios = scaled(s)
    mean = F.when(F.col("n") > 0, F.col("total") / 1000 / F.col("n")).otherwise(0.0)
    steps = F.array_repeat(mean, p.horizon)
    if forest is not None:
        start = F.struct(F.col("r").alias("past"), F.array().cast("array<double>").alias("out"))

        def step(a: Column, _: Column) -> Column:
            made = forest.predict(forest.bins(F.slice(a["past"], -p.lags, p.lags)))
            return F.transform(F.array(made), lambda v: F.struct(F.concat(a["past"], F.array(F.floor(v))).alias("past"), F.concat(a["out"], F.array(v)).alias("out")))[0]

        rolled = F.aggregate(F.sequence(F.lit(1), F.lit(p.horizon)), start, step, lambda a: F.transform(a["out"], lambda v: v * F.col("total") / F.col("n") / 1_000_000))
        steps = F.when((F.col("n") >= p.lags + 4) & F.col("r").isNotNull(), rolled).otherwise(steps)
    out = ratios.select("sku", F.posexplode(steps).alias("at", "v"))
    return out.select("sku", F.lit("RF").alias("engine"), (F.col("at") + 1).alias("h"), F.round("v", 4).alias("yhat"))
