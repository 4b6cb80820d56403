"""All queries of the procurement engine by name, and the SQL that states the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.staging import dealt, shared_dir, staged
from granary.operators import backtest, classify, finance, forecast, forest, fuzzy, history, inventory, summaries, suppliers, temporal
from granary.params import Params
from granary.plans import fixtures
from granary.plans.fixtures import SPARSE_SQL, SQL
from granary.plans.sql import register_sql
from granary.sources.ledgers import load_ledger
from granary.streaming.fifo import replayed
from granary.streaming.sessions import replayed_sessions, sessions

P = Params()
SKETCH = 12  # usual rows that a group's sketches take the room of
Query = Callable[[SparkSession, str], DataFrame]


class Ledgers:
    """The fixtures of one directory, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.pov = fixtures.pov(spark, sf_dir)
        self.grn = fixtures.grn(self.pov)
        self.pv = fixtures.pv(self.grn)
        self.stock = fixtures.stock(spark, sf_dir)

    @property
    def demand(self) -> DataFrame:
        return inventory.demand_balance(self.stock, self.grn, P.bucket)

    @property
    def gap_demand(self) -> DataFrame:
        return inventory.demand_balance(fixtures.sparse(self.stock), self.grn, P.bucket)

    @property
    def series(self) -> DataFrame:
        return forecast.series(self.demand)

    @property
    def classes(self) -> DataFrame:
        return classify.sbc_class(self.demand, P)

    @property
    def abc(self) -> DataFrame:
        return finance.abc_class(finance.value_by_sku(self.pov), P)

    def lead_by(self, *keys: str) -> DataFrame:
        return inventory.lead_times(inventory.fifo_match(self.pov, self.grn, list(keys)), list(keys))


def _query(f: Callable[[Ledgers], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Ledgers(spark, sf_dir))


def _doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that engines with other decimal widths compare."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def _top(led: Ledgers) -> DataFrame:
    return suppliers.top_trends(led.demand, P)


def _compare(led: Ledgers) -> DataFrame:
    """Every engine's forecast of the items of ``top10_trends``."""
    return forecast.forecast_compare(staged(forecast.series(_top(led)), "series"), P)  # read once for each engine


def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All purchase orders back from files of four layouts."""
    rows, _ = load_ledger(spark, "pov", fixtures.exports(spark, sf_dir))
    return _doubles(rows.select("po_id", "line_no", "sku", "vendor", "order_date", "qty", "amount"))


def fifo_hot_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = Ledgers(spark, sf_dir)
    return _doubles(inventory.lead_times(inventory.fifo_match_spread(fixtures.one_hot_item(led.pov), fixtures.one_hot_item(led.grn))))


def fifo_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fifo_lead_time from a stream of both ledgers."""
    led = Ledgers(spark, sf_dir)
    out = replayed(spark, led.pov, led.grn, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    return _doubles(inventory.lead_times(out.where("kind = 'match'")))


def spend_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = Ledgers(spark, sf_dir)
    lines = led.pov.join(fixtures.item_groups(spark, sf_dir), "sku").withColumn("quarter", inventory.period("order_date"))
    return _doubles(summaries.spend_cube(lines, ["vendor", "item_group", "quarter"]))


def stock_asof(led: Ledgers) -> DataFrame:
    """Stock on hand at each order's date."""
    snapshots = led.stock.select("sku", "as_of", F.col("qty").alias("snapshot"), "src_row")
    found = temporal.asof_join(led.pov, snapshots, ["sku"], "order_date", "as_of", {"on_hand": "snapshot", "as_of": "as_of"}, tie=["src_row"])
    return _doubles(found.select("po_id", "line_no", "sku", "vendor", "order_date", "qty", "on_hand", "as_of"))


def open_orders(led: Ledgers) -> DataFrame:
    """What was on order during each quarter: matched quantities from order to receipt."""
    spans = inventory.fifo_match(led.pov, led.grn)
    met = temporal.overlap_join(spans, fixtures.quarters(led.spark), [], ("order_date", "receipt_date"), ("begins", "ends"))
    return _doubles(met.groupBy("sku", "t").agg(F.count("*").alias("n_spans"), F.sum("matched").cast("decimal(28,3)").alias("open_qty")))


def sketch_bounds(led: Ledgers) -> DataFrame:
    """Whether sketches by vendor and month, merged by vendor, stay within their errors: rank of quartiles within 0.01, number of skus within 5%."""
    keys = ["sku", "vendor"]
    lines = fixtures.table(led.spark, led.sf_dir, "lineitem").count()
    matches = staged(inventory.fifo_match(led.pov, led.grn, keys, lines), "matches", release=True)
    last = matches.groupBy(*keys).agg(F.trunc(F.max("receipt_date"), "month").alias("month"))
    items = staged(inventory.lead_times(matches, keys).join(last, keys), "items")
    # A group's sketches take kilobytes, so tasks are dealt by the groups they may hold at once.
    groups = items.select("vendor", "month").distinct().count()
    stored = staged(summaries.vendor_sketches(dealt(items, groups * SKETCH, "vendor", "month"), ["vendor", "month"]), "sketches")
    said = summaries.told(summaries.merged(dealt(stored, groups * SKETCH, "vendor"), ["vendor"])).withColumnRenamed("vendor", "v")
    said = staged(said, "said")
    both = dealt(items, items.count(), "vendor").join(said, F.col("vendor") == F.col("v")).groupBy("vendor", "n_items", "n_skus", "q1", "median", "q3")
    d, n = F.col("lead_time_days"), F.count("*")

    def near(c: str, q: float):
        below, upto = F.count(F.when(d < F.col(c), 1)) / n, F.count(F.when(d <= F.col(c), 1)) / n
        return ((below <= q + 0.01) & (upto >= q - 0.01)).alias(f"{c}_ok")

    exact = F.count_distinct("sku")
    checked = both.agg(near("q1", 0.25), near("median", 0.5), near("q3", 0.75), (F.abs(F.first("n_skus") - exact) <= 0.05 * exact + 1).alias("skus_ok"))
    return checked.select("vendor", "n_items", "skus_ok", "q1_ok", "median_ok", "q3_ok")


def _sql(spark: SparkSession, sf_dir: str) -> None:
    led = Ledgers(spark, sf_dir)
    register_sql(spark, led.pov, led.grn, led.stock, P)


def sql_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sql(spark, sf_dir)
    return spark.sql("""
SELECT sku, CAST(sum(matched) AS DOUBLE) AS matched_qty, round(CAST(sum(matched * datediff(receipt_date, order_date)) / sum(matched) AS DOUBLE), 6) AS lead_time_days,
       CAST(coalesce(sum(matched) FILTER (WHERE receipt_date < order_date), 0) AS DOUBLE) AS early_qty
FROM fifo(TABLE(moves) PARTITION BY sku ORDER BY (move_date, src_file, src_row, line_no, vendor, qty, amount)) GROUP BY sku""")


def sql_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sql(spark, sf_dir)
    return spark.sql("SELECT * FROM forecast('TSB', 4, TABLE(demand) PARTITION BY sku ORDER BY t)")


def delivery_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """delivery_sessions from a stream of receipts."""
    return _doubles(replayed_sessions(spark, Ledgers(spark, sf_dir).grn, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")[0])


QUERIES: dict[str, Query] = {
    "abc_class": _query(lambda x: _doubles(x.abc.select("sku", "value", "rank", "running", "cumulative_share", "abc"))),
    "abc_distribution": _query(lambda x: _doubles(finance.abc_distribution(x.abc))),
    "pareto_curve": _query(lambda x: _doubles(x.abc.select("rank", "sku", "cumulative_share"))),
    "value_by_sku": _query(lambda x: _doubles(finance.value_by_sku(x.pov))),
    "fifo_lead_time": _query(lambda x: _doubles(x.lead_by("sku"))),
    "fifo_hot_item": fifo_hot_item,
    "fifo_stream": fifo_stream,
    "ledger_scan": ledger_scan,
    "pending_qty": _query(lambda x: _doubles(inventory.pending(x.pov, x.grn))),
    "demand_balance": _query(lambda x: _doubles(x.demand)),
    "unordered_qty": _query(lambda x: _doubles(inventory.sku_metrics(x.pov, x.grn, x.stock, P).select("sku", "unordered_qty"))),
    "trend_factor": _query(lambda x: _doubles(inventory.trend(x.demand))),
    "sku_metrics": _query(lambda x: _doubles(inventory.sku_metrics(x.pov, x.grn, x.stock, P))),
    "sbc_class": _query(lambda x: x.classes.select("sku", "n_periods", "n_demands", "adi", "cv2", "sbc")),
    "sbc_scatter": _query(lambda x: x.classes.select("sku", "adi", "cv2", "total", "sbc")),
    "tsb_forecast": _query(lambda x: forecast.tsb(x.series, P)),
    "glm_forecast": _query(lambda x: forecast.glm(x.series, P)),
    "rf_forecast": _query(lambda x: forecast.rf(x.series.join(x.classes.where("sbc = 'Smooth'"), "sku", "left_semi"), P)),
    "rf_pooled": _query(lambda x: forest.pooled(staged(x.series, "series"), P)),
    "rf_stump": _query(lambda x: forest.pooled(staged(x.series, "series"), replace(P, pooled_trees=1, tree_depth=1), bootstrap=False, subset=False)),
    "forecast_routed": _query(lambda x: forecast.forecast(x.series, x.classes, P)),
    "forecast_routed_formulas": _query(lambda x: forecast.forecast(x.series, x.classes, P).where("engine != 'RF'")),
    "demand_balance_gaps": _query(lambda x: _doubles(x.gap_demand)),
    "sbc_class_gaps": _query(lambda x: classify.sbc_class(x.gap_demand, P).select("sku", "n_periods", "n_demands", "adi", "cv2", "sbc")),
    "forecast_errors": _query(lambda x: forecast.forecast_errors(x.demand, P)),
    "backtest": _query(lambda x: backtest.backtest(x.series, P)),
    "forecast_errors_all": _query(lambda x: forecast.forecast_errors(x.demand, P, forecast.ENGINES)),
    "forecast_compare": _query(_compare),
    "forecast_history": _query(lambda x: forecast.beside_history(x.demand, x.series, P, ("GLM", "TSB"))),
    "forecast_compare_all": _query(lambda x: forecast.forecast_compare(x.series.join(_top(x).select("sku").distinct(), "sku", "left_semi"), P)),
    "supplier_risk": _query(lambda x: _doubles(suppliers.supplier_risk(x.pov, x.grn))),
    "supplier_clusters": _query(lambda x: suppliers.supplier_clusters(suppliers.supplier_risk(x.pov, x.grn), P)),
    "top10_trends": _query(lambda x: _doubles(_top(x))),
    "lead_time_box": _query(lambda x: _doubles(suppliers.lead_time_box(x.lead_by("sku", "vendor")))),
    "vendor_dedup": lambda spark, sf_dir: suppliers.dedup_vendors(fixtures.messy_vendors(spark, sf_dir)),
    "vendor_fuzzy": lambda spark, sf_dir: fuzzy.fuzzy_vendors(fixtures.misspelt_vendors(spark, sf_dir)),
    "spend_cube": spend_cube,
    "stock_asof": _query(stock_asof),
    "open_orders": _query(open_orders),
    "sketch_bounds": _query(sketch_bounds),
    "sql_fifo": sql_fifo,
    "sql_forecast": sql_forecast,
    "delivery_sessions": _query(lambda x: _doubles(sessions(x.grn))),
    "delivery_sessions_stream": delivery_sessions_stream,
    "historical_data": _query(lambda x: _doubles(history.historical({"pov": x.pov, "grn": x.grn, "pv": x.pv, "stock": x.stock}))),
}


def _fifo(keys: str) -> str:
    return f"""
, o AS (SELECT {keys}, order_date, qty, sum(qty) OVER (PARTITION BY {keys} ORDER BY order_date, po, ln, vendor, qty, amount ROWS UNBOUNDED PRECEDING) AS hi FROM pov),
r AS (SELECT {keys}, receipt_date, qty, sum(qty) OVER (PARTITION BY {keys} ORDER BY receipt_date, po, ln, vendor, qty, amount ROWS UNBOUNDED PRECEDING) AS hi FROM grn),
matches AS (
  SELECT {", ".join("o." + k.strip() for k in keys.split(","))}, order_date, receipt_date, least(o.hi, r.hi) - greatest(o.hi - o.qty, r.hi - r.qty) AS matched
  FROM o JOIN r ON {" AND ".join(f"o.{k.strip()} = r.{k.strip()}" for k in keys.split(","))} AND o.hi - o.qty < r.hi AND r.hi - r.qty < o.hi),
lead_times AS (
  SELECT {keys}, CAST(sum(matched) AS DOUBLE) AS matched_qty,
         round(CAST(CAST(sum(matched * date_diff('day', order_date, receipt_date)) AS DOUBLE) / CAST(sum(matched) AS DOUBLE) AS DOUBLE), 6) AS lead_time_days,
         CAST(coalesce(sum(matched) FILTER (receipt_date < order_date), 0) AS DOUBLE) AS early_qty
  FROM matches GROUP BY ALL)"""


#: Half of all rows are one item's: an overlap join would pair them all, so each piece looks up the next end of either ledger.
_HOT = (
    SQL.replace("CAST(l_partkey AS VARCHAR) AS sku", "CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 'HOT' ELSE CAST(l_partkey AS VARCHAR) END AS sku")
    + """
, o AS (SELECT sku, order_date, sum(qty) OVER (PARTITION BY sku ORDER BY order_date, po, ln, vendor, qty, amount ROWS UNBOUNDED PRECEDING) AS hi FROM pov WHERE qty > 0),
r AS (SELECT sku, receipt_date, sum(qty) OVER (PARTITION BY sku ORDER BY receipt_date, po, ln, vendor, qty, amount ROWS UNBOUNDED PRECEDING) AS hi FROM grn WHERE qty > 0),
ends AS (SELECT sku, hi FROM o UNION SELECT sku, hi FROM r),
cuts AS (SELECT sku, hi, hi - coalesce(lag(hi) OVER (PARTITION BY sku ORDER BY hi), 0) AS matched FROM ends),
pieces AS (
  SELECT c.sku, matched, date_diff('day', order_date, receipt_date) AS days
  FROM cuts c ASOF JOIN o ON c.sku = o.sku AND c.hi <= o.hi ASOF JOIN r ON c.sku = r.sku AND c.hi <= r.hi)"""
)
_ABC = """
, v AS (SELECT sku, sum(amount) AS value FROM pov GROUP BY sku),
ranked AS (SELECT sku, value, row_number() OVER w AS rank, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS running, sum(value) OVER () AS total FROM v WINDOW w AS (ORDER BY value DESC, sku)),
abc AS (SELECT *, round(CAST(running AS DOUBLE) / CAST(total AS DOUBLE), 8) AS cumulative_share,
               CASE WHEN running * 100 <= total * 80 THEN 'A' WHEN running * 100 <= total * 95 THEN 'B' ELSE 'C' END AS abc FROM ranked)"""
_PENDING = """
, moves AS (SELECT sku, qty AS ordered, 0 AS received FROM pov UNION ALL SELECT sku, 0, qty FROM grn),
open_orders AS (SELECT sku, sum(ordered) AS ordered, sum(received) AS received, greatest(sum(ordered) - sum(received), 0) AS pending_qty, greatest(sum(received) - sum(ordered), 0) AS received_without_po FROM moves GROUP BY sku)"""
_TREND = """
, sums AS (SELECT sku, count(*) AS n, sum(CAST(t AS DOUBLE)) AS st, sum(CAST(t AS DOUBLE) * t) AS stt, sum(CAST(demand AS DOUBLE)) AS sd, sum(t * CAST(demand AS DOUBLE)) AS std,
                  CAST(sum(demand) AS DOUBLE) AS total_demand, CAST(sum(negative) AS BIGINT) AS n_negative FROM demand GROUP BY sku),
trends AS (SELECT sku, total_demand, n_negative, CASE WHEN n * stt - st * st > 0 AND sd > 0 THEN round(((n * std - st * sd) / (n * stt - st * st)) / (sd / n), 6) END AS trend_factor FROM sums)"""
_METRICS = (
    SQL
    + _PENDING
    + _TREND
    + _fifo("sku")
    + """
, hand AS (SELECT sku, CAST(max_by(qty, t) AS DOUBLE) AS on_hand FROM stock GROUP BY sku),
metrics AS (
  SELECT coalesce(p.sku, h.sku, d.sku) AS sku, total_demand, n_negative, on_hand, CAST(pending_qty AS DOUBLE) AS pending_qty, CAST(received_without_po AS DOUBLE) AS received_without_po,
         greatest(coalesce(total_demand, 0) - coalesce(on_hand, 0) - coalesce(CAST(pending_qty AS DOUBLE), 0), 0.0) AS unordered_qty, lead_time_days, early_qty, trend_factor
  FROM open_orders p FULL JOIN hand h ON p.sku = h.sku FULL JOIN trends d ON d.sku = coalesce(p.sku, h.sku) LEFT JOIN lead_times l ON l.sku = coalesce(p.sku, h.sku, d.sku))"""
)


def _engines(cut: int, horizon: int) -> str:
    """TSB and GLM over each item's series without its last ``cut`` periods."""
    return f"""
, whole AS (SELECT sku, list(CAST(demand AS DOUBLE) ORDER BY t) AS y FROM demand GROUP BY sku),
series AS (SELECT sku, y[1:len(y) - {cut}] AS y FROM whole),
walk AS (
  SELECT sku, y, 0 AS i, CAST(0.5 AS DOUBLE) AS p, coalesce(list_filter(y, lambda v: v > 0)[1], CAST(0 AS DOUBLE)) AS z FROM series
  UNION ALL
  SELECT sku, y, i + 1, p + CAST(0.1 AS DOUBLE) * (CASE WHEN y[i + 1] > 0 THEN 1 ELSE 0 END - p), CASE WHEN y[i + 1] > 0 THEN z + CAST(0.2 AS DOUBLE) * (y[i + 1] - z) ELSE z END
  FROM walk WHERE i < len(y)),
tsb AS (SELECT sku, p * z AS f FROM walk WHERE i = len(y)),
start AS (SELECT sku, y, len(y) AS n, list_sum(y) / len(y) AS mean FROM series),
fit AS (
  SELECT sku, y, n, mean, 0 AS i, ln(greatest(mean, 1e-6)) AS b0, CAST(0 AS DOUBLE) AS b1 FROM start
  UNION ALL
  SELECT sku, y, n, mean, i + 1,
         CASE WHEN h0 * h2 - h1 * h1 > 1e-9 THEN b0 + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) ELSE b0 END,
         CASE WHEN h0 * h2 - h1 * h1 > 1e-9 THEN b1 + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) ELSE b1 END
  FROM (SELECT *, list_sum(list_transform(m, lambda v, k: y[k] - v)) AS g0, list_sum(list_transform(m, lambda v, k: (k / n) * (y[k] - v))) AS g1, list_sum(m) AS h0,
               list_sum(list_transform(m, lambda v, k: v * (k / n))) AS h1, list_sum(list_transform(m, lambda v, k: v * (k / n) * (k / n))) AS h2
        FROM (SELECT *, list_transform(y, lambda v, k: exp(least(greatest(b0 + b1 * (k / n), -20.0), 20.0))) AS m FROM fit WHERE i < 8))),
horizon AS (SELECT CAST(range AS INTEGER) + 1 AS h FROM range({horizon})),
tsb_made AS (SELECT sku, 'TSB' AS engine, h, round(f, 4) AS yhat FROM tsb CROSS JOIN horizon),
glm_made AS (
  SELECT sku, 'GLM' AS engine, h, round(CASE WHEN n > 1 AND mean > 0 THEN exp(least(greatest(b0 + b1 * ((n + h) / n), -20.0), 20.0)) ELSE mean END, 4) AS yhat
  FROM fit CROSS JOIN horizon WHERE i = 8)"""


def _summed(v: str) -> str:
    """The sum of a list of at most 128 doubles in numpy's order: eight running sums, added in pairs, then what is left over."""
    eight = [f"list_sum(list_transform(range({k}, len({v}) // 8 * 8 + 1, 8), lambda i: {v}[i]))" for k in range(1, 9)]
    while len(eight) > 1:
        eight = [f"({a} + {b})" for a, b in zip(eight[::2], eight[1::2], strict=True)]
    return f"CASE WHEN len({v}) < 8 THEN list_sum({v}) ELSE list_sum(list_concat([{eight[0]}], {v}[len({v}) // 8 * 8 + 1:])) END"


def _forest() -> str:
    """The small forest of each item of ``top``, as numpy makes it: PCG64 seeded with 42 gives the words, a row of ``grown`` draws a tree's
    points (``node`` null) or splits one node, in the order in which numbers are drawn; sums run in numpy's order, and the result is rounded from its exact value."""
    seeded, word, two = np.random.PCG64(42).state["state"], "4294967296", "18446744073709551616::UHUGEINT"

    def halves(v: int) -> tuple[str, str]:
        return f"{v >> 64}::UHUGEINT", f"{v % 2**64}::UHUGEINT"

    (hi, lo), (more_hi, more_lo), (times_hi, times_lo) = halves(seeded["state"]), halves(seeded["inc"]), halves(0x2360ED051FC65DA44385DF649FCCF645)
    fallen = "list_transform(trees, lambda t: {'t': t, 'place': 1})"
    for _ in range(3):
        below = "2 * a.place + CAST(past[a.t.f[a.place]] > a.t.cut[a.place] AS INTEGER)"
        fallen = f"list_transform({fallen}, lambda a: {{'t': a.t, 'place': CASE WHEN a.t.f[a.place] IS NULL THEN a.place ELSE {below} END}})"
    return f"""
, pcg AS (
  SELECT 0 AS i, {hi} AS hi, {lo} AS lo
  UNION ALL
  SELECT i + 1, ((low >> 64::UHUGEINT) + hi * {times_lo} % {two} + lo * {times_hi} % {two} + {more_hi}) % {two}, low % {two}
  FROM (SELECT *, lo * {times_lo} + {more_lo} AS low FROM pcg WHERE i < 10 * (SELECT max(len(y)) + 24 FROM series))),
raw AS (SELECT i, (xor(hi, lo) * 18446744073709551617::UHUGEINT >> (hi >> 58::UHUGEINT)) % {two} AS u FROM pcg WHERE i > 0),
drawn AS (
  SELECT list(CAST(w AS BIGINT) ORDER BY i, half) AS words
  FROM (SELECT i, 0 AS half, u % {word}::UHUGEINT AS w FROM raw UNION ALL SELECT i, 1, u // {word}::UHUGEINT FROM raw)),
grown AS (
  SELECT sku, y, len(y) - 3 AS n, -1 AS k, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS pick, CAST([] AS INTEGER[]) AS place, CAST(NULL AS INTEGER) AS node, CAST(NULL AS INTEGER) AS f, CAST(NULL AS DOUBLE) AS cut
  FROM series WHERE len(y) >= 7 AND sku IN (SELECT sku FROM top)
  UNION ALL
  SELECT sku, y, n, k, CASE WHEN node IS NULL THEN taken[n] WHEN mixed THEN turn + 1 ELSE pos END, CASE WHEN node IS NULL THEN list_transform(taken, lambda i: words[i] * n // {word} + 1) ELSE pick END,
         CASE WHEN node IS NULL THEN list_transform(taken, lambda i: 1) WHEN best IS NULL THEN place
              ELSE list_transform(place, lambda a, j: CASE WHEN a = node THEN 2 * node + CAST(y[pick[j] + best.f - 1] > best.cut AS INTEGER) ELSE a END) END,
         node, best.f, best.cut
  FROM (SELECT *, ways[list_position(gains, list_min(gains))] AS best FROM (
    SELECT *, list_transform(ways, lambda o: -(o.s * o.s / o.n + (o.total - o.s) * (o.total - o.s) / (len(held) - o.n))) AS gains FROM (
    SELECT *, flatten(list_transform(seen, lambda v: list_transform(list_filter(range(1, len(v.u)), lambda i: v.u[i] < v.u[i + 1]),
                                                                    lambda i: {{'f': v.f, 'cut': (v.u[i] + v.u[i + 1]) / 2, 'n': i, 's': list_sum(v.t[1:i]), 'total': v.total}}))) AS ways FROM (
    SELECT *, list_transform(turned, lambda v: {{'f': v.f, 'u': v.u, 't': v.t, 'total': {_summed("v.t")}}}) AS seen FROM (
    SELECT *, list_transform(sorted, lambda v: {{'f': v.f, 'u': list_transform(v.o, lambda e: e.u), 't': list_transform(v.o, lambda e: y[pick[e.j] + 3])}}) AS turned FROM (
    SELECT *, list_transform(CASE WHEN NOT mixed THEN [] WHEN words[turn + 1] % 2 = 0 THEN list_reverse(two) ELSE two END,
                             lambda f: {{'f': f, 'o': list_sort(list_transform(held, lambda j: {{'u': y[pick[j] + f - 1], 'j': j}}))}}) AS sorted FROM (
    SELECT *, [[3, 2], [1, 3], [1, 2]][words[turn] % 4 + 1] AS two, len(held) >= 4 AND list_min(w) < list_max(w) AS mixed FROM (
    SELECT *, list_transform(held, lambda j: y[pick[j] + 3]) AS w FROM (
    SELECT *, list_filter(range(1, len(place) + 1), lambda j: place[j] = node) AS held, list_filter(range(pos + 1, pos + 2 * n), lambda i: words[i] * n % {word} >= {word} % n)[1:n] AS taken,
           list_filter(range(pos + 1, pos + 50), lambda i: words[i] % 4 < 3)[1] AS turn FROM (
    SELECT sku, y, n, k + 1 AS k, pos, pick, place, [1, 2, 4, 5, 3, 6, 7][(k + 1) % 8] AS node, words FROM grown, drawn WHERE k < 159))))))))))),
leaves AS (
  SELECT sku, k // 8 AS tree, node, list_transform(list_filter(range(1, n + 1), lambda j: place[j] = node), lambda j: y[pick[j] + 3]) AS w
  FROM (SELECT * EXCLUDE (node) FROM grown WHERE k % 8 = 7) CROSS JOIN (SELECT unnest(range(1, 16)) AS node)),
ends AS (SELECT sku, tree, list(CASE WHEN len(w) > 0 THEN ({_summed("w")}) / len(w) END ORDER BY node) AS v FROM leaves GROUP BY ALL),
splits AS (SELECT sku, k // 8 AS tree, list(f ORDER BY node) AS f, list(cut ORDER BY node) AS cut FROM grown WHERE node IS NOT NULL GROUP BY ALL),
woods AS (SELECT s.sku, list({{'f': f, 'cut': cut, 'v': v}} ORDER BY s.tree) AS trees FROM splits s JOIN ends e ON e.sku = s.sku AND e.tree = s.tree GROUP BY s.sku),
rolled AS (
  SELECT s.sku, 0 AS h, y[len(y) - 2:len(y)] AS past, trees FROM series s JOIN woods w ON w.sku = s.sku
  UNION ALL
  SELECT sku, h + 1, [past[2], past[3], ({_summed("m")}) / 20], trees
  FROM (SELECT *, list_transform({fallen}, lambda a: a.t.v[a.place]) AS m FROM rolled WHERE h < 4)),
rf_made AS (
  SELECT s.sku, 'RF' AS engine, horizon.h, CAST(printf('%.4f', CASE WHEN len(y) >= 7 THEN past[3] ELSE coalesce(list_sum(y) / len(y), 0) END) AS DOUBLE) AS yhat
  FROM series s CROSS JOIN horizon LEFT JOIN rolled r ON r.sku = s.sku AND r.h = horizon.h WHERE s.sku IN (SELECT sku FROM top))"""


_RECURSIVE = SQL.replace("WITH pov", "WITH RECURSIVE pov", 1)
_TOP = ", top AS (SELECT sku, CAST(sum(demand) AS DOUBLE) AS total FROM demand GROUP BY sku ORDER BY sum(demand) DESC, sku LIMIT 10)"
_KEY = r"regexp_replace(upper(trim(vendor_name)), '[^\p{L}\p{M}\p{N}]+', '', 'g')"

_SESSIONS = """
, paced AS (SELECT vendor, receipt_date AS d, qty, lag(receipt_date) OVER (PARTITION BY vendor ORDER BY receipt_date) AS before FROM grn),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR d > before + 7 THEN 1 ELSE 0 END) OVER (PARTITION BY vendor ORDER BY d) AS s FROM paced)
SELECT vendor, min(d) AS first_day, max(d) + 7 AS end, count(*) AS n_receipts, CAST(sum(qty) AS DOUBLE) AS qty FROM numbered GROUP BY vendor, s"""
_ENDS = "CAST(DATE '1995-04-01' + CAST(i * 3 AS INTEGER) * INTERVAL 1 MONTH AS DATE)"

ORACLE: dict[str, str] = {
    "delivery_sessions": SQL + _SESSIONS,
    "delivery_sessions_stream": SQL + _SESSIONS,
    "sql_fifo": SQL + _fifo("sku") + " SELECT sku, matched_qty, lead_time_days, early_qty FROM lead_times",
    "sql_forecast": _RECURSIVE + _engines(0, 4) + " SELECT sku, engine, h, yhat FROM tsb_made",
    "sketch_bounds": SQL + _fifo("sku, vendor") + " SELECT vendor, count(*) AS n_items, true AS skus_ok, true AS q1_ok, true AS median_ok, true AS q3_ok FROM lead_times GROUP BY vendor",
    "open_orders": SQL
    + _fifo("sku")
    + f""" SELECT sku, CAST(7980 + i AS INTEGER) AS t, count(*) AS n_spans, CAST(sum(matched) AS DOUBLE) AS open_qty FROM matches
JOIN quarters ON order_date < {_ENDS} AND receipt_date > CAST({_ENDS} - INTERVAL 3 MONTH AS DATE) AND order_date < receipt_date GROUP BY sku, i""",
    "stock_asof": SQL
    + f""", snapshots AS (SELECT sku, qty, {_ENDS} - 1 AS as_of FROM stock)
SELECT CAST(po AS VARCHAR) AS po_id, ln AS line_no, p.sku, vendor, order_date, CAST(p.qty AS DOUBLE) AS qty, CAST(s.qty AS DOUBLE) AS on_hand, as_of FROM pov p ASOF LEFT JOIN snapshots s ON p.sku = s.sku AND p.order_date >= s.as_of""",
    "spend_cube": SQL
    + """ SELECT vendor, item_group, quarter, CAST(GROUPING_ID(vendor, item_group, quarter) AS INTEGER) AS level, CAST(sum(amount) AS DOUBLE) AS spend, CAST(sum(qty) AS DOUBLE) AS qty, count(*) AS n_lines
FROM (SELECT vendor, p_brand AS item_group, CAST(year(order_date) * 4 + quarter(order_date) - 1 AS INTEGER) AS quarter, amount, qty FROM pov JOIN part ON sku = CAST(p_partkey AS VARCHAR)) GROUP BY CUBE (vendor, item_group, quarter)""",
    "vendor_fuzzy": f"""
WITH RECURSIVE n AS (SELECT s_suppkey, translate(substr(md5(s_name), 1, 14), '0123456789', 'ghijklmnop') AS n FROM supplier),
spelled AS (
  SELECT s_suppkey AS vendor_id, v AS spelling,
         CASE v WHEN 0 THEN n WHEN 1 THEN upper(substr(n, 1, 6)) || ' - ' || substr(n, 7, 8) WHEN 2 THEN substr(n, 1, 4) || substr(n, 6, 9) ELSE substr(n, 1, 7) || 'z' || substr(n, 9, 6) END AS vendor_name
  FROM n CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS v)),
keyed AS (SELECT *, {_KEY} AS vendor_key FROM spelled),
k AS (SELECT key, list_distinct(list_transform(range(1, length(key) + 2), lambda i: substr('_' || key || '_', i, 2))) AS g FROM (SELECT DISTINCT vendor_key AS key FROM keyed)),
e AS (SELECT a.key AS x, b.key AS y FROM k a JOIN k b ON a.key <> b.key AND 100 * len(list_intersect(a.g, b.g)) >= 60 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))),
reach AS (SELECT key AS node, key AS root FROM k UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node),
groups AS (SELECT node, min(root) AS group_key FROM reach GROUP BY node)
SELECT vendor_id, spelling, vendor_name, vendor_key, group_key, min(vendor_name) OVER (PARTITION BY group_key) AS canonical_name FROM keyed JOIN groups ON node = vendor_key""",
    "abc_class": SQL + _ABC + " SELECT sku, CAST(value AS DOUBLE) AS value, rank, CAST(running AS DOUBLE) AS running, cumulative_share, abc FROM abc",
    "abc_distribution": SQL + _ABC + " SELECT abc, count(*) AS n_skus, CAST(sum(value) AS DOUBLE) AS value FROM abc GROUP BY abc",
    "pareto_curve": SQL + _ABC + " SELECT rank, sku, cumulative_share FROM abc",
    "value_by_sku": SQL + " SELECT sku, CAST(sum(amount) AS DOUBLE) AS value, CAST(sum(qty) AS DOUBLE) AS qty, count(*) AS n_lines FROM pov GROUP BY sku",
    "fifo_lead_time": SQL + _fifo("sku") + " SELECT sku, matched_qty, lead_time_days, early_qty FROM lead_times",
    "fifo_stream": SQL + _fifo("sku") + " SELECT sku, matched_qty, lead_time_days, early_qty FROM lead_times",
    "fifo_hot_item": _HOT
    + """ SELECT sku, CAST(sum(matched) AS DOUBLE) AS matched_qty, round(CAST(sum(matched * days) AS DOUBLE) / CAST(sum(matched) AS DOUBLE), 6) AS lead_time_days,
       CAST(coalesce(sum(matched) FILTER (days < 0), 0) AS DOUBLE) AS early_qty FROM pieces GROUP BY sku""",
    "ledger_scan": SQL + " SELECT CAST(po AS VARCHAR) AS po_id, ln AS line_no, sku, vendor, order_date, CAST(qty AS DOUBLE) AS qty, CAST(amount AS DOUBLE) AS amount FROM pov",
    "pending_qty": SQL + _PENDING + " SELECT sku, CAST(ordered AS DOUBLE) AS ordered, CAST(received AS DOUBLE) AS received, CAST(pending_qty AS DOUBLE) AS pending_qty, CAST(received_without_po AS DOUBLE) AS received_without_po FROM open_orders",
    "demand_balance": SQL + " SELECT sku, t, CAST(demand AS DOUBLE) AS demand, negative FROM demand",
    "unordered_qty": _METRICS + " SELECT sku, unordered_qty FROM metrics",
    "trend_factor": SQL + _TREND + " SELECT sku, total_demand, n_negative, trend_factor FROM trends",
    "sku_metrics": _METRICS + " SELECT * FROM metrics",
    "sbc_class": SQL + " SELECT sku, n_periods, n_demands, adi, cv2, sbc FROM classes",
    "sbc_scatter": SQL + " SELECT sku, adi, cv2, total, sbc FROM classes",
    "tsb_forecast": _RECURSIVE + _engines(0, 4) + " SELECT sku, engine, h, yhat FROM tsb_made",
    "glm_forecast": _RECURSIVE + _engines(0, 4) + " SELECT sku, engine, h, yhat FROM glm_made",
    "forecast_routed_formulas": _RECURSIVE
    + _engines(0, 4)
    + """ SELECT m.sku, engine, h, yhat FROM (SELECT * FROM tsb_made UNION ALL SELECT * FROM glm_made) m JOIN classes c ON c.sku = m.sku
WHERE (engine = 'GLM' AND sbc = 'Erratic') OR (engine = 'TSB' AND sbc IN ('Intermittent', 'Lumpy'))""",
    "rf_stump": SQL
    + """
, base AS (SELECT sku, list(round(CAST(demand AS DOUBLE) * 1000) ORDER BY t) AS m, count(*) AS n, sum(round(CAST(demand AS DOUBLE) * 1000)) AS total FROM demand GROUP BY sku),
ratios AS (SELECT sku, n, total, CASE WHEN total > 0 AND n >= 7 THEN list_transform(m, lambda v: CAST(floor(v * n * 1000 / total) AS BIGINT)) END AS r FROM base),
obs AS (SELECT sku, [r[i - 3], r[i - 2], r[i - 1]] AS x, r[i] AS y FROM (SELECT sku, r, unnest(range(4, n + 1)) AS i FROM ratios WHERE r IS NOT NULL)),
long AS (SELECT f, x[f] AS v, y FROM obs CROSS JOIN (SELECT unnest([1, 2, 3]) AS f)),
ranked AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS place, count(*) OVER (PARTITION BY f) AS n FROM long),
borders AS (SELECT DISTINCT f, v AS border FROM ranked JOIN (SELECT unnest(range(1, 32)) AS k) ON place = CAST(ceil(k / 32 * n) AS BIGINT)),
sides AS (
  SELECT b.f, border, CAST(count(*) FILTER (v <= border) AS DOUBLE) AS ln, CAST(coalesce(sum(y) FILTER (v <= border), 0) AS DOUBLE) AS ls, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s
  FROM borders b JOIN long l ON l.f = b.f GROUP BY b.f, border),
split AS (SELECT f, border, ls / ln AS low, (s - ls) / (n - ln) AS high FROM sides WHERE ln > 0 AND ln < n ORDER BY ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n DESC, f, border LIMIT 1),
h0 AS (SELECT sku, n, total, r[n - 2] AS a, r[n - 1] AS b, r[n] AS c, r IS NOT NULL AS ok FROM ratios),
h1 AS (SELECT h0.*, CASE WHEN [a, b, c][f] <= border THEN low ELSE high END AS v1 FROM h0 CROSS JOIN split),
h2 AS (SELECT h1.*, CASE WHEN [b, c, floor(v1)][f] <= border THEN low ELSE high END AS v2 FROM h1 CROSS JOIN split),
h3 AS (SELECT h2.*, CASE WHEN [c, floor(v1), floor(v2)][f] <= border THEN low ELSE high END AS v3 FROM h2 CROSS JOIN split),
h4 AS (SELECT h3.*, CASE WHEN [floor(v1), floor(v2), floor(v3)][f] <= border THEN low ELSE high END AS v4 FROM h3 CROSS JOIN split),
made AS (SELECT sku, n, total, ok, unnest([v1, v2, v3, v4]) AS v, unnest([1, 2, 3, 4]) AS h FROM h4)
SELECT sku, 'RF' AS engine, CAST(h AS INTEGER) AS h, round(CASE WHEN ok THEN v * total / n / 1000000 ELSE total / 1000 / n END, 4) AS yhat FROM made""",
    "demand_balance_gaps": SPARSE_SQL + " SELECT sku, t, CAST(demand AS DOUBLE) AS demand, negative FROM gap_demand",
    "sbc_class_gaps": SPARSE_SQL + " SELECT sku, n_periods, n_demands, adi, cv2, sbc FROM classes",
    "forecast_errors": _RECURSIVE
    + _engines(4, 4)
    + """
, actual AS (SELECT sku, CAST(t - max(t) OVER (PARTITION BY sku) + 4 AS INTEGER) AS h, CAST(demand AS DOUBLE) AS y FROM demand),
gaps AS (SELECT m.sku, engine, yhat - y AS gap, y FROM (SELECT * FROM tsb_made UNION ALL SELECT * FROM glm_made) m JOIN actual a ON a.sku = m.sku AND a.h = m.h)
SELECT sku, engine, round(avg(abs(gap)), 6) AS mae, round(sqrt(avg(gap * gap)), 6) AS rmse, round(avg(gap), 6) AS bias, round(avg(abs(gap) / y) FILTER (y > 0), 6) AS mape FROM gaps GROUP BY ALL""",
    "backtest": _RECURSIVE
    + _engines(0, 4).replace("SELECT sku, y[1:len(y) - 0] AS y FROM whole", "SELECT sku || '@' || n AS sku, y[1:n] AS y FROM (SELECT sku, y, unnest(range(8, len(y))) AS n FROM whole)")
    + """
, made AS (
  SELECT split_part(m.sku, '@', 1) AS sku, CAST(split_part(m.sku, '@', 2) AS INTEGER) AS n, engine, h, yhat FROM (SELECT * FROM tsb_made UNION ALL SELECT * FROM glm_made) m),
gaps AS (
  SELECT m.sku, engine, h, yhat - y[n + h] AS gap, list_sum(list_transform(range(2, n + 1), lambda i: abs(y[i] - y[i - 1]))) / (n - 1) AS scale
  FROM made m JOIN whole w ON w.sku = m.sku WHERE n + h <= len(y))
SELECT sku, engine, h, count(*) AS n_origins, round(avg(abs(gap)), 6) AS mae, round(sqrt(avg(gap * gap)), 6) AS rmse, round(avg(gap), 6) AS bias,
       round(avg(abs(gap) / scale) FILTER (scale > 0), 6) AS mase FROM gaps GROUP BY ALL""",
    "forecast_compare": _RECURSIVE
    + _engines(0, 4)
    + _TOP
    + _forest()
    + """ SELECT g.sku, g.h, r.yhat AS "RF", g.yhat AS "GLM", t.yhat AS "TSB" FROM glm_made g JOIN tsb_made t ON g.sku = t.sku AND g.h = t.h
LEFT JOIN rf_made r ON r.sku = g.sku AND r.h = g.h WHERE g.sku IN (SELECT sku FROM top)""",
    "forecast_history": _RECURSIVE
    + _engines(0, 4)
    + """ SELECT sku, t, 'history' AS kind, CAST(demand AS DOUBLE) AS y FROM demand
UNION ALL SELECT m.sku, CAST(last + h AS INTEGER) AS t, engine AS kind, yhat AS y FROM (SELECT * FROM tsb_made UNION ALL SELECT * FROM glm_made) m JOIN (SELECT sku, max(t) AS last FROM demand GROUP BY sku) l ON l.sku = m.sku""",
    "supplier_risk": SQL
    + _fifo("sku, vendor")
    + """
, spend AS (SELECT vendor, CAST(sum(amount) AS DOUBLE) AS spend, count(DISTINCT sku) AS n_skus, count(*) AS n_lines, sum(qty) AS ordered FROM pov GROUP BY vendor),
got AS (SELECT vendor, sum(qty) AS received FROM grn GROUP BY vendor),
leads AS (SELECT vendor, round(avg(lead_time_days), 4) AS lead_time_mean,
                 round(sqrt(greatest((count(*) * sum(lead_time_days * lead_time_days) - sum(lead_time_days) * sum(lead_time_days)) / (count(*) * count(*)), 0.0)), 4) AS lead_time_spread
          FROM lead_times GROUP BY vendor)
SELECT s.vendor, spend, round(spend / sum(spend) OVER (), 8) AS spend_share, n_skus, n_lines, lead_time_mean, lead_time_spread,
       round(greatest(CAST(ordered - coalesce(received, 0) AS DOUBLE) / CAST(ordered AS DOUBLE), 0.0), 6) AS pending_ratio
FROM spend s LEFT JOIN got g ON g.vendor = s.vendor LEFT JOIN leads l ON l.vendor = s.vendor""",
    "top10_trends": SQL + _TOP + " SELECT d.sku, total, t, CAST(demand AS DOUBLE) AS demand FROM demand d JOIN top ON top.sku = d.sku",
    "lead_time_box": SQL
    + _fifo("sku, vendor")
    + """ SELECT vendor, count(*) AS n, min(lead_time_days) AS low, round(quantile_cont(lead_time_days, 0.25), 4) AS q1, round(quantile_cont(lead_time_days, 0.5), 4) AS median,
       round(quantile_cont(lead_time_days, 0.75), 4) AS q3, max(lead_time_days) AS high FROM lead_times GROUP BY vendor""",
    "vendor_dedup": f"""
WITH spelled AS (
  SELECT s_suppkey AS vendor_id, v AS spelling, CASE v WHEN 0 THEN s_name WHEN 1 THEN '  ' || lower(s_name) || '.' ELSE replace(s_name, '#', ' - ') END AS vendor_name
  FROM supplier CROSS JOIN (SELECT unnest([0, 1, 2]) AS v)),
keyed AS (SELECT *, {_KEY} AS vendor_key FROM spelled)
SELECT vendor_id, spelling, vendor_name, vendor_key, min(vendor_name) OVER (PARTITION BY vendor_key) AS canonical_name FROM keyed""",
    "historical_data": SQL
    + """
SELECT 'pov' AS ledger, sku, vendor, order_date AS date, CAST(qty AS DOUBLE) AS qty, CAST(amount AS DOUBLE) AS amount FROM pov
UNION ALL SELECT 'grn', sku, vendor, receipt_date, CAST(qty AS DOUBLE), CAST(amount AS DOUBLE) FROM grn
UNION ALL SELECT 'pv', sku, vendor, receipt_date + 7, CAST(qty AS DOUBLE), CAST(amount AS DOUBLE) FROM grn
UNION ALL SELECT 'stock', sku, NULL, CAST(DATE '1995-04-01' + CAST(i * 3 AS INTEGER) * INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), CAST(qty AS DOUBLE), NULL FROM stock""",
}
