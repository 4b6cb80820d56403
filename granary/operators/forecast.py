"""Forecast engines, routing by demand class, and errors on a holdout.

TSB and the GLM are higher-order functions over each item's ordered series, so they stay in the JVM; the forest
is numpy on one item's few points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.staging import staged
from granary.params import Params

ENGINES = ("RF", "GLM", "TSB")
TOGETHER = 1_000  # items whose forests are grown side by side
ROUTES = {"Smooth": "RF", "Erratic": "GLM", "Intermittent": "TSB", "Lumpy": "TSB"}  # fixed: the class decides the engine


def series(demand: DataFrame, without_last: int = 0) -> DataFrame:
    """(sku, y): each item's demand in order of time, without its last periods if asked."""
    points = F.array_sort(F.collect_list(F.struct("t", F.col("demand").cast("double").alias("y"))))
    s = demand.groupBy("sku").agg(F.transform(points, lambda x: x["y"]).alias("y"))
    return s.withColumn("y", F.slice("y", 1, F.greatest(F.size("y") - without_last, F.lit(0)))) if without_last else s


def _steps(df: DataFrame, engine: str, value, p: Params) -> DataFrame:
    out = df.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(p.horizon))))
    return out.select("sku", F.lit(engine).alias("engine"), "h", F.round(value(F.col("h")), 4).alias("yhat"))


def tsb(s: DataFrame, p: Params = Params()) -> DataFrame:
    """Teunter-Syntetos-Babai: the demand probability is smoothed every period, the size when there is demand; flat."""
    first = F.coalesce(F.get(F.filter("y", lambda y: y > 0), F.lit(0)), F.lit(0.0))
    start = F.struct(F.lit(p.start_probability).alias("p"), first.alias("z"))

    def step(a: Column, y: Column) -> Column:
        hit = F.when(y > 0, 1.0).otherwise(0.0)
        return F.struct((a["p"] + p.alpha * (hit - a["p"])).alias("p"), F.when(y > 0, a["z"] + p.beta * (y - a["z"])).otherwise(a["z"]).alias("z"))

    fitted = s.withColumn("f", F.aggregate("y", start, step, lambda a: a["p"] * a["z"]))
    return _steps(fitted, "TSB", lambda h: F.col("f"), p)


def glm(s: DataFrame, p: Params = Params()) -> DataFrame:
    """Poisson regression with log link on an intercept and scaled time, by iteratively reweighted least squares.

    Falls back to the mean where the series has no demand or fewer than two points (assumed)."""
    n = F.size("y")
    mean = F.aggregate("y", F.lit(0.0), lambda a, y: a + y) / F.greatest(n, F.lit(1))
    points = F.transform(F.col("y"), lambda y, i: F.struct(((i + 1) / n).cast("double").alias("x"), y.alias("y")))
    zero = F.lit(0.0)

    def newton(b: Column, _: Column) -> Column:
        def add(a: Column, q: Column) -> Column:
            m = F.exp(F.least(F.greatest(b["b0"] + b["b1"] * q["x"], F.lit(-20.0)), F.lit(20.0)))
            return F.struct(
                (a["g0"] + q["y"] - m).alias("g0"), (a["g1"] + q["x"] * (q["y"] - m)).alias("g1"), (a["h0"] + m).alias("h0"), (a["h1"] + m * q["x"]).alias("h1"),
                (a["h2"] + m * q["x"] * q["x"]).alias("h2"),
            )

        start = F.struct(*[zero.alias(k) for k in ("g0", "g1", "h0", "h1", "h2")])

        def solve(a: Column) -> Column:
            det = a["h0"] * a["h2"] - a["h1"] * a["h1"]
            return F.when(
                det > 1e-9,
                F.struct((b["b0"] + (a["h2"] * a["g0"] - a["h1"] * a["g1"]) / det).alias("b0"), (b["b1"] + (a["h0"] * a["g1"] - a["h1"] * a["g0"]) / det).alias("b1")),
            ).otherwise(b)

        return F.aggregate(F.col("points"), start, add, solve)

    first = F.struct(F.log(F.greatest(F.col("mean"), F.lit(1e-6))).alias("b0"), zero.alias("b1"))
    base = s.withColumns({"mean": mean, "points": points})
    fitted = base.withColumn("b", F.aggregate(F.sequence(F.lit(1), F.lit(p.glm_steps)), first, newton))
    ok = (F.size("y") > 1) & (F.col("mean") > 0)

    def value(h: Column) -> Column:
        eta = F.col("b.b0") + F.col("b.b1") * ((F.size("y") + h) / F.size("y"))
        return F.when(ok, F.exp(F.least(F.greatest(eta, F.lit(-20.0)), F.lit(20.0)))).otherwise(F.col("mean"))

    return _steps(fitted, "GLM", value, p)


def _tree(x: np.ndarray, y: np.ndarray, depth: int, rng) -> tuple | float:
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return float(y.mean())
    best = (np.inf, 0, 0.0)
    for j in rng.permutation(x.shape[1])[: max(1, x.shape[1] - 1)]:
        order = np.argsort(x[:, j], kind="stable")
        v, w = x[order, j], y[order]
        left = np.cumsum(w)[:-1]
        n = np.arange(1, len(w))
        gain = -(left**2 / n + (w.sum() - left) ** 2 / (len(w) - n))
        gain[v[1:] == v[:-1]] = np.inf
        i = int(gain.argmin())
        if gain[i] < best[0]:
            best = (float(gain[i]), int(j), float((v[i] + v[i + 1]) / 2))
    if not np.isfinite(best[0]):
        return float(y.mean())
    go = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[go], y[go], depth - 1, rng), _tree(x[~go], y[~go], depth - 1, rng)


def _value(tree, x: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def forest(y: np.ndarray, p: Params) -> list[float]:
    """A bootstrap forest on the last ``lags`` values, rolled forward; the mean if there are too few points. One item's, to say what
    ``forests`` gives for many."""
    if len(y) < p.lags + 4:
        return [float(y.mean()) if len(y) else 0.0] * p.horizon
    x = np.lib.stride_tricks.sliding_window_view(y, p.lags)[:-1]
    goal = y[p.lags :]
    rng = np.random.default_rng(p.seed)
    trees = []
    for _ in range(p.trees):
        pick = rng.integers(0, len(goal), len(goal))
        trees.append(_tree(x[pick], goal[pick], p.tree_depth, rng))
    past, out = list(y[-p.lags :]), []
    for _ in range(p.horizon):
        out.append(float(np.mean([_value(t, np.array(past)) for t in trees])))
        past = [*past[1:], out[-1]]
    return out


def _grown(x: np.ndarray, y: np.ndarray, rngs: list, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_tree`` of many items at once: x is (item, point, lag), y (item, point). Returns (feature, threshold, value) by item and heap place;
    node 1 is the root, 2i and 2i + 1 are below i, and feature is -1 where a node isn't split."""
    heap = 2 << p.tree_depth
    feature, threshold, value = np.full((len(y), heap), -1), np.zeros((len(y), heap)), np.zeros((len(y), heap))

    def node(at: int, depth: int, items: np.ndarray, held: np.ndarray) -> None:
        """Splits node ``at`` of the items, then all below it: an item draws its numbers in the order in which it would alone."""
        sizes, go = held.sum(axis=1), np.zeros(len(items), bool)
        for size in np.unique(sizes):  # nodes of one size lie side by side, so sums run as they do over one node's points
            rows = np.flatnonzero(sizes == size)
            points = np.nonzero(held[rows])[1].reshape(len(rows), size)
            own = items[rows]
            w = np.take_along_axis(y[own], points, axis=1)
            value[own, at] = w.mean(axis=1)
            if depth == 0 or size < 4:
                continue
            some = np.flatnonzero(w.min(axis=1) != w.max(axis=1))
            if not len(some):
                continue
            rows, own, w = rows[some], own[some], w[some]
            v = np.take_along_axis(x[own], points[some][:, :, None], axis=1)
            seen = np.stack([rngs[i].permutation(x.shape[2])[: max(1, x.shape[2] - 1)] for i in own])
            best, each, n = np.full(len(own), np.inf), np.arange(len(own)), np.arange(1, size)
            for f in seen.T:
                u = v[each, :, f]
                order = np.argsort(u, axis=1, kind="stable")
                u, t = np.take_along_axis(u, order, axis=1), np.take_along_axis(w, order, axis=1)
                left = np.cumsum(t, axis=1)[:, :-1]
                gain = -(left**2 / n + (t.sum(axis=1)[:, None] - left) ** 2 / (size - n))
                gain[u[:, 1:] == u[:, :-1]] = np.inf
                i = gain.argmin(axis=1)
                better = gain[each, i] < best
                best[better] = gain[each, i][better]
                feature[own[better], at], threshold[own[better], at] = f[better], ((u[each, i] + u[each, i + 1]) / 2)[better]
            go[rows] = np.isfinite(best)
        if go.any():
            items, held = items[go], held[go]
            low = np.take_along_axis(x[items], feature[items, at][:, None, None], axis=2)[:, :, 0] <= threshold[items, at][:, None]
            node(2 * at, depth - 1, items, held & low)
            node(2 * at + 1, depth - 1, items, held & ~low)

    node(1, p.tree_depth, np.arange(len(y)), np.ones(y.shape, bool))
    return feature, threshold, value


def forests(y: np.ndarray, p: Params) -> np.ndarray:
    """``forest`` of items of equal length, a row each, with the same numbers drawn and the same results."""
    if y.shape[1] < p.lags + 4:
        return np.repeat(y.mean(axis=1)[:, None] if y.shape[1] else np.zeros((len(y), 1)), p.horizon, axis=1)
    x = np.lib.stride_tricks.sliding_window_view(y, p.lags, axis=1)[:, :-1]
    goal = y[:, p.lags :]
    rngs = [np.random.default_rng(p.seed) for _ in y]
    trees = []
    for _ in range(p.trees):
        pick = np.stack([r.integers(0, goal.shape[1], goal.shape[1]) for r in rngs])
        trees.append(_grown(np.take_along_axis(x, pick[:, :, None], axis=1), np.take_along_axis(goal, pick, axis=1), rngs, p))
    past, each, out = y[:, -p.lags :].copy(), np.arange(len(y)), []
    for _ in range(p.horizon):
        made = np.empty((len(y), p.trees))
        for t, (feature, threshold, value) in enumerate(trees):
            at = np.ones(len(y), int)
            for _ in range(p.tree_depth):
                f = feature[each, at]
                at = np.where(f < 0, at, 2 * at + (past[each, f] > threshold[each, at]))
            made[:, t] = value[each, at]
        out.append(made.mean(axis=1))
        past = np.concatenate([past[:, 1:], out[-1][:, None]], axis=1)
    return np.stack(out, axis=1)


def rf(s: DataFrame, p: Params = Params()) -> DataFrame:
    """The forest engine: one small forest for each item in Python, or one pooled forest grown from Spark aggregates."""
    if p.forest == "pooled":
        from granary.operators.forest import pooled

        return pooled(s, p)

    def kernel(batches):
        for pdf in batches:
            sizes = pdf.y.map(len).to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for some in np.split(rows, range(TOGETHER, len(rows), TOGETHER)):
                    made = forests(np.array([np.asarray(y, float) for y in pdf.y.iloc[some]]).reshape(len(some), size), p)
                    skus, h = pdf.sku.iloc[some].repeat(p.horizon), np.tile(np.arange(1, p.horizon + 1), len(some))
                    yield pd.DataFrame({"sku": skus.to_numpy(), "engine": "RF", "h": h, "yhat": [round(v, 4) for v in made.ravel().tolist()]})

    return s.select("sku", "y").mapInPandas(kernel, "sku string, engine string, h int, yhat double")


KERNELS = {"RF": rf, "GLM": glm, "TSB": tsb}


def forecast(s: DataFrame, classes: DataFrame, p: Params = Params()) -> DataFrame:
    """Each item's forecast by the engine of its class; items without demand have none."""
    joined = staged(s.join(classes.select("sku", "sbc"), "sku"), "series")  # read once for each engine
    parts = [KERNELS[e](joined.where(F.col("sbc").isin([c for c, x in ROUTES.items() if x == e])), p) for e in ENGINES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def forecast_compare(s: DataFrame, p: Params = Params(), engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """Every engine's forecast side by side."""
    parts = [KERNELS[e](s, p) for e in engines]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("sku", "h").pivot("engine", list(engines)).agg(F.first("yhat"))


def beside_history(demand: DataFrame, s: DataFrame, p: Params = Params(), engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """(sku, t, kind, y): each item's demand by period, kind "history", and after its last period every engine's forecast, kind being the
    engine: the lines of a chart that lays forecasts over history."""
    past = demand.select("sku", "t", F.lit("history").alias("kind"), F.col("demand").cast("double").alias("y"))
    last = demand.groupBy("sku").agg(F.max("t").alias("last"))
    made = KERNELS[engines[0]](s, p)
    for e in engines[1:]:
        made = made.unionByName(KERNELS[e](s, p))
    ahead = made.join(last, "sku").select("sku", (F.col("last") + F.col("h")).alias("t"), F.col("engine").alias("kind"), F.col("yhat").alias("y"))
    return past.unionByName(ahead)


def forecast_errors(demand: DataFrame, p: Params = Params(), engines: tuple[str, ...] = ("GLM", "TSB")) -> DataFrame:
    """MAE, RMSE, bias and MAPE (over actuals above 0) by item and engine on the last ``holdout`` periods."""
    demand = staged(demand, "demand")  # read for the actual values and by each engine
    ahead = F.row_number().over(_latest())
    actual = demand.withColumn("_r", ahead).where(F.col("_r") <= p.holdout).select("sku", (F.lit(p.holdout + 1) - F.col("_r")).alias("h"), F.col("demand").cast("double").alias("y"))
    s = series(demand, p.holdout).where(F.size("y") > 0)
    q = Params(**{**p.__dict__, "horizon": p.holdout})
    made = KERNELS[engines[0]](s, q)
    for e in engines[1:]:
        made = made.unionByName(KERNELS[e](s, q))
    gap = F.col("yhat") - F.col("y")
    return made.join(actual, ["sku", "h"]).groupBy("sku", "engine").agg(
        F.round(F.avg(F.abs(gap)), 6).alias("mae"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"), F.round(F.avg(gap), 6).alias("bias"), F.round(F.avg(F.when(F.col("y") > 0, F.abs(gap) / F.col("y"))), 6).alias("mape")
    )


def _latest():
    from pyspark.sql.window import Window

    return Window.partitionBy("sku").orderBy(F.desc("t"))
