"""All ledgers in one view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATES = {"pov": "order_date", "grn": "receipt_date", "pv": "invoice_date", "stock": "as_of"}


def historical(ledgers: dict[str, DataFrame]) -> DataFrame:
    """(ledger, sku, vendor, date, qty, amount): purchase vouchers appear here and feed no metric."""
    parts = []
    for name, df in ledgers.items():
        vendor = F.col("vendor") if "vendor" in df.columns else F.lit(None).cast("string")
        amount = F.col("amount") if "amount" in df.columns else F.col("value")
        parts.append(df.select(F.lit(name).alias("ledger"), "sku", vendor.alias("vendor"), F.col(DATES[name]).alias("date"), "qty", amount.alias("amount")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
