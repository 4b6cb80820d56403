"""The engine's one entry point: file groups in, result frames out.

Frames are lazy but for what they share: typed ledgers, demand, series, item values, vendors' spend and the cluster model are computed
when the dict is made, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.staging import staged
from granary.operators import backtest, classify, finance, forecast, history, inventory, suppliers
from granary.params import Params
from granary.sources.ledgers import Reading, load_ledger


def analyse(pov: DataFrame, grn: DataFrame, stock: DataFrame, pv: DataFrame | None = None, p: Params = Params()) -> dict[str, DataFrame]:
    demand = staged(inventory.demand_balance(stock, grn, p.bucket), "demand")
    classes = classify.sbc_class(demand, p)
    per_item = inventory.lead_times(inventory.fifo_match(pov, grn, ["sku", "vendor"]), ["sku", "vendor"])
    ledgers = {"pov": pov, "grn": grn, **({"pv": pv} if pv is not None else {}), "stock": stock}
    abc, risk, series = finance.abc_class(finance.value_by_sku(pov), p), suppliers.supplier_risk(pov, grn), staged(forecast.series(demand), "series")
    return {
        "abc_data": abc,
        "abc_distribution": finance.abc_distribution(abc),
        "historical_data": history.historical(ledgers),
        "supplier_data": risk,
        "supplier_clusters": suppliers.supplier_clusters(risk, p),
        "lead_time_data": suppliers.lead_time_box(per_item),
        "top10_trends": suppliers.top_trends(demand, p),
        "sbc_data": classes,
        "sku_metrics": inventory.sku_metrics(pov, grn, stock, p),
        "demand_history": demand,
        "forecast": forecast.forecast(series, classes, p),
        "forecast_compare": forecast.forecast_compare(series, p),
        "forecast_history": forecast.beside_history(demand, series, p),
        "backtest": backtest.backtest(series, p),
        "forecast_errors": forecast.forecast_errors(demand, p, forecast.ENGINES),
    }


def process_multiledger(
    spark: SparkSession, pov_paths: list[str], grn_paths: list[str], stock_paths: list[str], pv_paths: list[str] | None = None, p: Params = Params(bucket="month"),
    caps: dict[str, int] | None = None, reading: Reading = Reading(),
) -> dict[str, DataFrame]:
    """All analyses of the given files, and ``rejects`` (rows that could not be typed, with reasons)."""
    loaded = {k: load_ledger(spark, k, paths, caps, reading) for k, paths in (("pov", pov_paths), ("grn", grn_paths), ("stock", stock_paths), ("pv", pv_paths or []))}
    for k in ("pov", "grn", "pv"):  # spellings of a vendor become one
        rows, bad = loaded[k]
        loaded[k] = (rows.withColumn("vendor", suppliers.vendor_key(F.col("vendor"))), bad)
    rejects = None
    for _, bad in loaded.values():
        rejects = bad if rejects is None else rejects.unionByName(bad)
    out = analyse(loaded["pov"][0], loaded["grn"][0], loaded["stock"][0], loaded["pv"][0] if pv_paths else None, p)
    return {**out, "rejects": rejects}
