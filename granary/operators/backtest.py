"""Rolling-origin backtests: every engine forecasts from the end of every long enough beginning of a series.

All origins of an item come from its one row, and its errors go out of the task already averaged: a few rows an item, whatever the number of
origins, so the series is read once, never joined to itself, and nothing is shuffled. Items of equal length are worked out side by side
in arrays, place after place, so that sums run in the order of time, as in the SQL and in ``forecast``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.functions.staging import spread, staged
from granary.params import Params

TOGETHER = 2_000  # items worked out side by side: their arrays stay in the processor's cache
ENGINES = ("GLM", "TSB")


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(v) * 10.0**digits + 0.5) / 10.0**digits, v) + 0.0


def tsb_states(y: np.ndarray, p: Params) -> np.ndarray:
    """TSB's forecast after 1, 2, ... periods, a row an item. Before the first demand it is 0, as the fit of a beginning without demand is."""
    hit = y > 0
    first = np.take_along_axis(y, hit.argmax(axis=1)[:, None], axis=1)[:, 0]
    prob, z, seen, out = np.full(len(y), p.start_probability), np.where(hit.any(axis=1), first, 0.0), np.zeros(len(y), bool), np.empty_like(y)
    for i in range(y.shape[1]):
        v, h = y[:, i], hit[:, i]
        prob, z, seen = prob + p.alpha * (h - prob), np.where(h, z + p.beta * (v - z), z), seen | h
        out[:, i] = np.where(seen, prob * z, 0.0)
    return out


def glm_ahead(y: np.ndarray, p: Params) -> np.ndarray:
    """The Poisson regression's forecasts for the ``horizon`` periods after y: ``forecast.glm`` of all items at once."""
    n, mean = y.shape[1], np.cumsum(y, axis=1)[:, -1] / y.shape[1]
    places = [((k + 1) / n, y[:, k]) for k in range(n)]
    b0, b1 = np.log(np.maximum(mean, 1e-6)), np.zeros(len(y))
    for _ in range(p.glm_steps):
        g0, g1, h0, h1, h2 = (np.zeros(len(y)) for _ in range(5))
        for x, v in places:
            m = np.exp(np.minimum(np.maximum(b0 + b1 * x, -20.0), 20.0))
            gap, mx = v - m, m * x
            g0 += gap
            g1 += x * gap
            h0 += m
            h1 += mx
            h2 += mx * x
        det = h0 * h2 - h1 * h1
        ok = det > 1e-9
        det = np.where(ok, det, 1.0)
        b0, b1 = np.where(ok, b0 + (h2 * g0 - h1 * g1) / det, b0), np.where(ok, b1 + (h0 * g1 - h1 * g0) / det, b1)
    ahead = np.stack([np.exp(np.clip(b0 + b1 * ((n + h) / n), -20.0, 20.0)) for h in range(1, p.horizon + 1)], axis=1)
    return np.where(((mean > 0) & (n > 1))[:, None], ahead, mean[:, None])


def errors(y: np.ndarray, p: Params) -> Iterator[tuple]:
    """(engine, h, n_origins, mae, rmse, bias, mase) for items of equal length, a row of y each; the last four are arrays over the items, mase with
    not-a-number where no origin has a scale."""
    length = y.shape[1]
    tsb, naive = tsb_states(y, p), np.cumsum(np.abs(np.diff(y, axis=1)), axis=1)
    sums: dict[tuple[str, int], np.ndarray] = {}
    for n in range(p.backtest_from, length):
        scale = naive[:, n - 2] / (n - 1) if n > 1 else np.zeros(len(y))
        known = scale > 0
        made = {"GLM": rounded(glm_ahead(y[:, :n], p), 4), "TSB": rounded(np.repeat(tsb[:, n - 1 : n], p.horizon, axis=1), 4)}
        for engine in ENGINES:
            for h in range(1, min(p.horizon, length - n) + 1):
                gap = made[engine][:, h - 1] - y[:, n + h - 1]
                size = np.abs(gap)
                add = np.stack([np.ones(len(y)), size, gap * gap, gap, np.where(known, size / np.where(known, scale, 1.0), 0.0), known])
                sums[engine, h] = sums[engine, h] + add if (engine, h) in sums else add
    for (engine, h), (count, size, square, gap, relative, scaled) in sums.items():
        mase = np.where(scaled > 0, relative / np.maximum(scaled, 1.0), np.nan)
        yield engine, h, int(count[0]) if len(count) else 0, rounded(size / count, 6), rounded(np.sqrt(square / count), 6), rounded(gap / count, 6), rounded(mase, 6)


def backtest(s: DataFrame, p: Params = Params()) -> DataFrame:
    """(sku, engine, h, n_origins, mae, rmse, bias, mase) over all origins from ``backtest_from`` periods on. MASE scales each error by
    the mean change from period to period before its origin; origins without any change are left out of it (null if all are).

    Means of four-decimal errors can lie halfway between two sixth decimals: which one it is then depends on a sum's last bits. Sums run in
    the order of time, as plain SQL's do; an engine that adds in another order may differ there by 0.000001."""

    def kernel(batches):
        for batch in batches:
            lists = batch.column(1)
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(starts)
            for length in np.unique(sizes[sizes > p.backtest_from]):
                rows = np.flatnonzero(sizes == length)
                for some in np.split(rows, range(TOGETHER, len(rows), TOGETHER)):
                    skus = batch.column(0).take(pa.array(some))
                    for engine, h, count, *means in errors(flat[starts[some][:, None] + np.arange(length)], p):
                        m = len(some)
                        cells = [skus, pa.array([engine] * m), pa.array(np.full(m, h, np.int32)), pa.array(np.full(m, count, np.int64)), *[pa.array(v, from_pandas=True) for v in means]]
                        yield pa.RecordBatch.from_arrays(cells, ["sku", "engine", "h", "n_origins", "mae", "rmse", "bias", "mase"])

    s = spread(staged(s, "series")).select("sku", "y")  # an item's origins are worked out in its row, so rows weigh much
    kind = s.schema["sku"].dataType.simpleString()
    return s.mapInArrow(kernel, f"sku {kind}, engine string, h int, n_origins long, mae double, rmse double, bias double, mase double")
