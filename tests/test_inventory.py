import datetime as dt
import random
from decimal import Decimal

import pytest

from granary.operators import classify, finance, forecast, inventory, suppliers
from granary.params import Params

POV = "sku string, vendor string, order_date date, qty decimal(18,3), amount decimal(18,2), line_no int, src_file string, src_row long"
GRN = POV.replace("order_date", "receipt_date")


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def rows(items):
    return [(s, "v", day(d), Decimal(q), Decimal(1), 1, "f", i) for i, (s, d, q) in enumerate(items)]


def test_fifo_splits_by_hand(spark):
    pov = spark.createDataFrame(rows([("a", 0, 10), ("a", 5, 10), ("a", 9, 5)]), POV)
    grn = spark.createDataFrame(rows([("a", 7, 12), ("a", 12, 6)]), GRN)
    got = {(r.order_date, r.receipt_date): int(r.matched) for r in inventory.fifo_match(pov, grn).collect()}
    assert got == {(day(0), day(7)): 10, (day(5), day(7)): 2, (day(5), day(12)): 6}
    lead = inventory.lead_times(inventory.fifo_match(pov, grn)).first()
    assert lead.lead_time_days == pytest.approx((10 * 7 + 2 * 2 + 6 * 7) / 18, abs=1e-6)


def test_fifo_conserves_quantity(spark):
    rnd = random.Random(3)
    o = [(rnd.choice("abc"), rnd.randrange(30), rnd.randrange(1, 9)) for _ in range(60)]
    g = [(rnd.choice("abcd"), rnd.randrange(30), rnd.randrange(1, 9)) for _ in range(50)]
    m = inventory.fifo_match(spark.createDataFrame(rows(o), POV), spark.createDataFrame(rows(g), GRN))
    got = {r.sku: int(r.q) for r in m.groupBy("sku").agg({"matched": "sum"}).withColumnRenamed("sum(matched)", "q").collect()}
    total = lambda x, s: sum(q for k, _, q in x if k == s)
    assert got == {s: min(total(o, s), total(g, s)) for s in "abc" if min(total(o, s), total(g, s))}


def test_demand_with_gaps_in_stock(spark):
    """Receipts between two snapshots count whatever their period, and every calendar period has a row."""
    stock = spark.createDataFrame(
        [("a", dt.date(2020, 3, 31), Decimal(10), 1), ("a", dt.date(2020, 9, 30), Decimal(5), 2), ("a", dt.date(2020, 10, 31), Decimal(9), 3)],
        "sku string, as_of date, qty decimal(18,3), src_row long",
    )
    got = [
        ("a", dt.date(2020, 3, 30), Decimal(7)), ("a", dt.date(2020, 5, 1), Decimal(100)), ("a", dt.date(2020, 9, 30), Decimal("0.5")),
        ("a", dt.date(2020, 12, 1), Decimal(3)), ("b", dt.date(2020, 5, 1), Decimal(3)),
    ]
    grn = spark.createDataFrame(got, "sku string, receipt_date date, qty decimal(18,3)")
    rows = inventory.demand_balance(stock, grn, "month").orderBy("t").collect()
    first = 2020 * 12 + 3
    assert [(r.t, r.demand, r.negative) for r in rows] == [
        *[(first + k, Decimal("17.583"), 0) for k in range(5)], (first + 5, Decimal("17.585"), 0), (first + 6, Decimal(0), 1)
    ]
    assert classify.sbc_class(inventory.demand_balance(stock, grn, "month")).first().n_periods == 7


def test_abc_and_pareto(spark):
    values = spark.createDataFrame([("a", Decimal(80)), ("b", Decimal(15)), ("c", Decimal(5)), ("d", Decimal(0))], "sku string, value decimal(18,2)")
    got = {r.sku: (r.abc, r.cumulative_share) for r in finance.abc_class(values).collect()}
    assert got == {"a": ("A", 0.8), "b": ("B", 0.95), "c": ("C", 1.0), "d": ("C", 1.0)}


def test_classes_on_the_cutoffs(spark):
    def series(name, ys):
        return [(name, t, Decimal(y), 0) for t, y in enumerate(ys)]

    data = series("smooth", [5, 5, 5, 5]) + series("erratic", [1, 9, 1, 1]) + series("thin", [5, 0, 0, 5]) + series("lumpy", [1, 0, 0, 0, 20]) + series("none", [0, 0])
    d = spark.createDataFrame(data, "sku string, t int, demand decimal(28,3), negative int")
    got = {r.sku: r.sbc for r in classify.sbc_class(d).collect()}
    assert got == {"smooth": "Smooth", "erratic": "Erratic", "thin": "Intermittent", "lumpy": "Lumpy", "none": "NoDemand"}
    assert {r.sbc for r in classify.sbc_class(d.where("sku = 'smooth'"), Params(adi_cutoff=1.0)).collect()} == {"Intermittent"}


def test_tsb_by_hand(spark):
    s = spark.createDataFrame([("a", [5.0, 0.0, 0.0, 3.0, 0.0])], "sku string, y array<double>")
    assert {r.yhat for r in forecast.tsb(s).collect()} == {2.0739}


def test_glm_matches_the_library(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import GeneralizedLinearRegression

    y = [3.0, 0.0, 4.0, 7.0, 6.0, 9.0, 4.0, 12.0]
    points = spark.createDataFrame([(v, Vectors.dense((i + 1) / 8)) for i, v in enumerate(y)], ["label", "features"])
    m = GeneralizedLinearRegression(family="poisson", link="log", maxIter=50, tol=1e-10).fit(points)
    ask = spark.createDataFrame([(Vectors.dense((8 + h) / 8),) for h in range(1, 5)], ["features"])
    want = [r.prediction for r in m.transform(ask).collect()]
    s = spark.createDataFrame([("a", y), ("zero", [0.0, 0.0])], "sku string, y array<double>")
    got = forecast.glm(s, Params(glm_steps=20)).orderBy("sku", "h").collect()
    assert [r.yhat for r in got[:4]] == pytest.approx(want, abs=1e-3)
    assert {r.yhat for r in got[4:]} == {0.0}


def test_forest_follows_a_pattern():
    import numpy as np

    y = np.array([2.0, 8.0] * 12)
    out = forecast.forest(y, Params(trees=40, tree_depth=3))
    assert out[0] < 4 < 6 < out[1]


def test_errors_of_all_engines_by_hand(spark):
    # Four points are too few for the forest, which forecasts their mean, 5; the gaps are 0, -2, 2 and 5.
    demand = spark.createDataFrame([("A", t, y) for t, y in enumerate([2, 4, 6, 8, 5, 7, 3, 0])], "sku string, t int, demand int")
    got = {r.engine: r for r in forecast.forecast_errors(demand, Params(), forecast.ENGINES).collect()}
    assert set(got) == {"RF", "GLM", "TSB"}
    assert (got["RF"].mae, got["RF"].rmse, got["RF"].bias, got["RF"].mape) == (2.25, 2.872281, 1.25, 0.31746)


def test_errors_of_all_engines_are_returned(spark):
    import os

    from granary.api import analyse
    from granary.plans import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    x = catalog.Ledgers(spark, sf)
    got = analyse(x.pov, x.grn, x.stock, p=catalog.P)["forecast_errors"].collect()
    assert {r.engine for r in got} == {"RF", "GLM", "TSB"} and len({(r.sku, r.engine) for r in got}) == len(got) == 3 * len({r.sku for r in got})
    assert sorted(got) == sorted(catalog.QUERIES["forecast_errors_all"](spark, sf).collect())


def test_vendor_key_is_idempotent(spark):
    v = spark.createDataFrame([("  Acme, Ltd. ",), ("ACME LTD",), ("acme-ltd",), (None,)], "vendor_name string")
    got = suppliers.dedup_vendors(v).select("vendor_key").distinct().collect()
    assert sorted(r[0] or "" for r in got) == ["", "ACMELTD"]
    other = spark.createDataFrame([("株式会社",), ("ООО Ромашка",), ("ооо «Ромашка»",), ("--",), ("!",)], "vendor_name string")
    assert sorted(r.vendor_key for r in suppliers.dedup_vendors(other).collect()) == ["!", "--", "ОООРОМАШКА", "ОООРОМАШКА", "株式会社"]


def test_clusters_without_lead_times(spark):
    risk = [(v, 0.1 * k, None if k == 2 else 3.0 + k, None if k == 2 else 1.0, 0.0, 4) for k, v in enumerate("abcd")]
    got = suppliers.supplier_clusters(spark.createDataFrame(risk, "vendor string, spend_share double, lead_time_mean double, lead_time_spread double, pending_ratio double, n_skus long"))
    assert {r.vendor: r.lead_time_mean for r in got.collect()}["c"] == pytest.approx((3 + 4 + 6) / 3)


def test_tasks_of_demand_follow_the_rows(spark, monkeypatch, tmp_path):
    """Neither the snapshots nor what is made of them lie in a fixed number of tasks."""
    from granary.functions import staging
    from granary.plans import fixtures

    spark.range(300).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(fixtures, "PARTS", 20)
    monkeypatch.setattr(staging, "TASK_ROWS", 100)
    stock = fixtures.stock(spark, str(tmp_path))
    assert stock.rdd.getNumPartitions() == 16
    demand = inventory.demand_balance(stock, spark.createDataFrame([], "sku string, receipt_date date, qty decimal(18,3)"))
    assert demand.rdd.getNumPartitions() == 300 * fixtures.QUARTERS // 100 + 1
    assert demand.count() == 300 * (fixtures.QUARTERS - 1)


def test_clusters_match_ledgers_once(spark):
    pov = spark.createDataFrame([("a", v, day(i), Decimal(i + 1), Decimal(i * i + 1), 1, "f", i) for i, v in enumerate("uvwxyz")], POV)
    out = suppliers.supplier_clusters(suppliers.supplier_risk(pov, pov.withColumnRenamed("order_date", "receipt_date")))
    assert out.count() == 6
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_orders_follow_the_lines(spark, monkeypatch):
    """Lines and orders meet in tasks whose size doesn't follow the tables'."""
    from granary.functions import staging
    from granary.plans import fixtures

    few = fixtures.pov(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(staging, "TASK_ROWS", 500)
    many = fixtures.pov(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few))
