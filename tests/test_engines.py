"""Scans across cuts, FIFO of a hot item, the pooled forest and backtests against plain versions of themselves."""

import random
from contextlib import contextmanager
from dataclasses import replace
from math import exp, floor, log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.segmented import segmented
from granary.functions.staging import spread, staged
from granary.operators import forecast, forest, inventory
from granary.operators.backtest import backtest
from granary.params import Params

P = Params()


@contextmanager
def no_coalescing(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key)


def test_segmented_equals_windows(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), i, rnd.randint(-5, 9), rnd.choice([None, None, "x", "y", "z"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at long, v long, w string").repartition(5)
    with no_coalescing(spark):
        got = segmented(df, ["k"], [F.desc("at")], {"run": "v"}, {"seen": "w"}, {"after": "w"})
        assert got.where("k = 'hot'").select("part").distinct().count() >= 3
        got = {r.at: (r.run, r.seen, r.after) for r in got.collect()}
    by = Window.partitionBy("k").orderBy(F.desc("at"))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("at", F.sum("v").over(upto).alias("run"), F.last("w", ignorenulls=True).over(upto).alias("seen"), F.lead("w").over(by).alias("after")).collect()
    assert got == {r.at: (r.run, r.seen, r.after) for r in want}
    assert segmented(df.limit(0), ["k"], [F.col("at")], {"run": "v"}).count() == 0


def test_segmented_keys_that_fill_whole_parts(spark):
    """One key over all parts, and keys that begin or end at a cut."""
    for keys in (["a"] * 400, ["a"] * 100 + ["b"] * 100 + ["c"] * 100 + ["d"] * 100, ["a"] * 399 + ["b"], ["a"] + ["b"] * 399):
        df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long")
        with no_coalescing(spark):
            got = {r.i: (r.run, r.nxt) for r in segmented(df.withColumn("one", F.lit(1)), ["k"], [F.col("i")], {"run": "one"}, nexts={"nxt": "i"}).collect()}
        assert got == {i: (keys[: i + 1].count(k), i + 1 if keys[i + 1 : i + 2] == [k] else None) for i, k in enumerate(keys)}


LEDGER = "sku string, vendor string, d date, qty decimal(18,3), amount decimal(18,2), src_file string, src_row long, line_no int"


def _ledgers(spark, n=900):
    import datetime
    from decimal import Decimal

    rnd = random.Random(2)
    day = lambda: datetime.date(2020, 1, 1) + datetime.timedelta(rnd.randint(0, 200))
    rows = lambda m: [("hot" if rnd.random() < 0.5 else f"s{rnd.randint(0, 20)}", "v", day(), Decimal(rnd.choice([0, 1, 2, 5, 7])), Decimal(1), "f", i, 1) for i in range(m)]
    pov = spark.createDataFrame(rows(n), LEDGER).withColumnRenamed("d", "order_date")
    return pov, spark.createDataFrame(rows(n - 200), LEDGER).withColumnRenamed("d", "receipt_date")


def test_fifo_of_a_hot_item_is_spread(spark):
    pov, grn = _ledgers(spark)

    def pieces(df):
        return sorted((r.sku, str(r.order_date), str(r.receipt_date), r.q) for r in df.groupBy("sku", "order_date", "receipt_date").agg(F.sum("matched").alias("q")).collect())

    with no_coalescing(spark):
        got = inventory.fifo_match_spread(pov, grn)
        parts = got.where("sku = 'hot'").select("part").distinct().count()
        assert parts >= 2 and got.select("part").distinct().count() - parts <= 2  # half of the rows, about half of the tasks
        assert pieces(got) == pieces(inventory.fifo_match(pov, grn))
    assert inventory.fifo_match_spread(pov, grn.limit(0)).count() == 0


def _series(spark, n=60, periods=26):
    rnd = random.Random(3)
    rows = [(f"s{i}", [round(rnd.choice([0.0, rnd.uniform(0, 9), 3 + t * 0.3]), 3) for t in range(periods)]) for i in range(n)]
    rows += [("short", [1.0, 2.0, 3.0]), ("none", [0.0] * periods), ("one", [5.0]), ("empty", [])]
    return spark.createDataFrame(rows, "sku string, y array<double>")


def _ratios(y):
    milli = [round(v * 1000) for v in y]
    return [floor(v * len(y) * 1000 / sum(milli)) for v in milli] if sum(milli) else None


def _plain_tree(rows, lags, depth, node, tree, seed, subset):
    """Rows (bins, target, weight) to {node: mean} and {node: (feature, bin)}."""
    n, s = sum(w for *_, w in rows), sum(t * w for _, t, w in rows)
    best, chosen = 0.0, None
    if depth:
        for f in range(lags):
            if subset and f == forest.left_out(tree, node, seed, lags):
                continue
            for b in sorted({x[f] for x, *_ in rows})[:-1]:
                ln, ls = sum(w for x, _, w in rows if x[f] <= b), sum(t * w for x, t, w in rows if x[f] <= b)
                gain = float(ls) * float(ls) / ln + float(s - ls) * float(s - ls) / (n - ln) - float(s) * float(s) / n
                if gain > best:
                    best, chosen = gain, (f, b)
    if chosen is None:
        return {node: float(s) / n}, {}
    f, b = chosen
    values, splits = {}, {node: chosen}
    for side, child in ((True, 2 * node), (False, 2 * node + 1)):
        v, c = _plain_tree([r for r in rows if (r[0][f] <= b) == side], lags, depth - 1, child, tree, seed, subset)
        values |= v
        splits |= c
    return values, splits


@pytest.mark.parametrize("bootstrap", [False, True])
def test_forest_is_that_of_brute_force(spark, bootstrap):
    s, lags, trees, depth = _series(spark), 3, 4, 3
    obs = forest.observations(forest.scaled(s), lags)
    made = forest.grow(obs, lags, trees, depth, P.seed, bootstrap, subset=bootstrap)
    want = []
    for r in s.collect():
        if len(r.y) >= lags + 4 and (q := _ratios(r.y)):
            want += [(r.sku, i, q[i - lags : i], q[i]) for i in range(lags, len(q))]
    assert sorted((r.sku, r.i, r.x, r.target) for r in obs.collect()) == sorted(want)
    borders = [[sorted(x[j] for _, _, x, _ in want)[-(-len(want) * k // forest.BINS) - 1] for k in range(1, forest.BINS)] for j in range(lags)]
    assert made.borders == [sorted(set(b)) for b in borders]
    drawn = obs.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select("sku", "i", "tree", forest.weight(F.col("tree"), P.seed, bootstrap).alias("w")).collect()
    weights = {(r.tree, r.sku, r.i): r.w for r in drawn}
    if bootstrap:
        assert abs(sum(weights.values()) / len(weights) - 1) < 0.05
    for tree in range(trees):
        rows = [([sum(b < v for b in bs) for v, bs in zip(x, made.borders, strict=True)], t, weights[tree, sku, i]) for sku, i, x, t in want if weights[tree, sku, i]]
        values, splits = _plain_tree(rows, lags, depth, 1, tree, P.seed, bootstrap)
        at = tree * made.heap
        assert {k: made.value[at + k] for k in values} == values
        assert {k: (made.feature[at + k], made.last_left[at + k]) for k in range(1, made.heap) if made.feature[at + k] >= 0} == splits


def test_pooled_forecast_rolls_forward(spark):
    s = _series(spark)
    p = replace(P, pooled_trees=5)
    got = {}
    for r in forest.pooled(s, p).collect():
        got.setdefault(r.sku, {})[r.h] = r.yhat
    made = forest.grow(forest.observations(forest.scaled(s), p.lags), p.lags, p.pooled_trees, p.tree_depth, p.seed)
    for r in s.collect():
        q = _ratios(r.y) if len(r.y) >= p.lags + 4 else None
        if q is None:
            assert got[r.sku] == {h: round(sum(r.y) / max(len(r.y), 1), 4) for h in range(1, 5)}
            continue
        total = sum(round(v * 1000) for v in r.y)
        for h in range(1, 5):
            value = 0.0
            for tree in range(made.trees):
                node = 1
                while made.feature[tree * made.heap + node] >= 0:
                    f = made.feature[tree * made.heap + node]
                    node = 2 * node + (sum(b < q[-p.lags + f] for b in made.borders[f]) > made.last_left[tree * made.heap + node])
                value += made.value[tree * made.heap + node]
            value /= made.trees
            assert abs(got[r.sku][h] - value * total / len(r.y) / 1_000_000) < 1e-3
            q.append(floor(value))
    assert {r.engine for r in forecast.rf(s, replace(p, forest="pooled")).collect()} == {"RF"}
    assert forest.pooled(s.where("sku = 'none'"), p).count() == 4  # nothing to learn from: the mean
    assert forest.pooled(s.limit(0), p).count() == 0


def test_backtest_of_every_origin(spark):
    s = _series(spark, n=6, periods=14)
    got = {(r.sku, r.engine, r.h): r for r in backtest(s, P).collect()}
    rows = {r.sku: r.y for r in s.collect()}
    assert {k[0] for k in got} == {k for k, y in rows.items() if len(y) > P.backtest_from}
    for sku, y in rows.items():
        gaps = {}
        for n in range(P.backtest_from, len(y)):
            known = y[:n]
            part = spark_free_forecasts(known)
            scale = sum(abs(a - b) for a, b in zip(known[1:], known, strict=False)) / (n - 1)
            for engine, yhat in part.items():
                for h in range(1, min(P.horizon, len(y) - n) + 1):
                    gaps.setdefault((engine, h), []).append((round(yhat[h - 1], 4) - y[n + h - 1], scale))
        for (engine, h), g in gaps.items():
            r = got[sku, engine, h]
            assert r.n_origins == len(g)
            assert abs(r.mae - sum(abs(x) for x, _ in g) / len(g)) < 1e-3 and abs(r.rmse - sqrt(sum(x * x for x, _ in g) / len(g))) < 1e-3 and abs(r.bias - sum(x for x, _ in g) / len(g)) < 1e-3
            some = [abs(x) / c for x, c in g if c > 0]
            assert r.mase is None if not some else abs(r.mase - sum(some) / len(some)) < 1e-3


def test_backtest_shuffles_nothing(spark):
    """Errors leave a task averaged: no row for each origin, no exchange after the series."""
    plan = backtest(staged(_series(spark, n=6, periods=14), "series"), P)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Aggregate" not in plan


def spark_free_forecasts(y):
    n, mean = len(y), sum(y) / len(y)
    prob, z = P.start_probability, next((v for v in y if v > 0), 0.0)
    for v in y:
        prob += P.alpha * ((v > 0) - prob)
        z += P.beta * (v - z) if v > 0 else 0
    b0, b1 = log(max(mean, 1e-6)), 0.0
    for _ in range(P.glm_steps):
        m = [exp(min(max(b0 + b1 * i / n, -20), 20)) for i in range(1, n + 1)]
        x = [i / n for i in range(1, n + 1)]
        g0, g1 = sum(v - a for v, a in zip(y, m, strict=True)), sum(q * (v - a) for q, v, a in zip(x, y, m, strict=True))
        h0, h1, h2 = sum(m), sum(q * a for q, a in zip(x, m, strict=True)), sum(q * q * a for q, a in zip(x, m, strict=True))
        det = h0 * h2 - h1 * h1
        if det > 1e-9:
            b0, b1 = b0 + (h2 * g0 - h1 * g1) / det, b1 + (h0 * g1 - h1 * g0) / det
    glm = [exp(min(max(b0 + b1 * (n + h) / n, -20), 20)) if mean > 0 else mean for h in range(1, P.horizon + 1)]
    return {"TSB": [prob * z] * P.horizon, "GLM": glm}


def test_spread_gives_every_core_a_part(spark):
    one = staged(spark.range(10).coalesce(1), "one")
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(one.repartition(9)).rdd.getNumPartitions() == 9


def test_forests_side_by_side_are_those_of_each_item():
    """The same numbers drawn, the same sums: equal to the last bit, whatever shapes the items' trees have."""
    rng = np.random.default_rng(5)
    for length in (0, 3, 6, 7, 12, 23, 40):
        y = np.concatenate([rng.integers(0, 40, (20, length)) * 1.0, rng.gamma(2.0, 7.3, (20, length)), np.full((2, length), 3.1), rng.integers(0, 2, (9, length)) * 5.0])
        assert forecast.forests(y, P).tolist() == [forecast.forest(v, P) for v in y]
