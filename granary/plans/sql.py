"""The ledgers and the engines in SQL: views, and table functions that take a table by item.

    register_sql(spark, pov, grn, stock)
    spark.sql("SELECT * FROM fifo(TABLE(moves) PARTITION BY sku ORDER BY (move_date, src_file, src_row, line_no, vendor, qty, amount))")
    spark.sql("SELECT * FROM forecast('TSB', 4, TABLE(demand) PARTITION BY sku ORDER BY t)")

The functions keep one item's rows in Python (``fifo`` as Arrow arrays), so a hot item is one task's; ``inventory.fifo_match`` and
``forecast.forecast`` do all items in the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, udtf

from granary.operators.inventory import demand_balance
from granary.params import Params

P = Params()


@arrow_udtf(returnType="sku string, order_date date, receipt_date date, matched decimal(28,3)")
class FifoRows:
    """Matches of one item's moves, receipts to orders first in, first out; the rows must come by date.

    An item's rows come as Arrow batches and are matched in arrays: both sides are laid end to end by quantity, and their right ends
    cut the axis into pieces that each belong to one order and one receipt, as in ``inventory.fifo_match``."""

    def __init__(self):
        self.batches = []

    def eval(self, moves: pa.RecordBatch):
        self.batches.append(moves)

    def terminate(self):
        sku, receipt, day, qty = [], [], [], []
        for rows in self.batches:
            of = rows.schema.get_field_index
            sku.append(rows.column(of("sku")).slice(0, 1))
            receipt.append(rows.column(of("receipt")).to_numpy(zero_copy_only=False))
            day.append(_days(rows.column(of("move_date"))))
            qty.append(_thousandths(rows.column(of("qty"))))
        if not sku:
            return
        receipt, day, qty = (x[0] if len(x) == 1 else np.concatenate(x) for x in (receipt, day, qty))
        use = qty > 0
        o, r = (use & ~receipt).nonzero()[0], (use & receipt).nonzero()[0]
        if not len(o) or not len(r):
            return
        ends = qty[o].cumsum(), qty[r].cumsum()
        cuts = np.concatenate([[0], *ends])
        cuts.sort()
        cuts = cuts[: cuts.searchsorted(min(ends[0][-1], ends[1][-1]), "right")]
        size = cuts[1:] - cuts[:-1]
        cuts, size = cuts[1:][size > 0], size[size > 0]
        dates = [_dates(day[i[e.searchsorted(cuts)]]) for i, e in zip((o, r), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.repeat(sku[0][0], len(cuts)), *dates, _decimals(size)], _MATCHES)


_MATCHES = ["sku", "order_date", "receipt_date", "matched"]
NO_DAY = np.iinfo(np.int32).min


def _days(column: pa.Array) -> np.ndarray:
    """Days since 1970; NO_DAY for null."""
    days = column.view(pa.int32())
    return (days.fill_null(NO_DAY) if days.null_count else days).to_numpy()


def _dates(days: np.ndarray) -> pa.Array:
    none = days == NO_DAY
    if none.any():
        return pa.array(days, mask=none).view(pa.date32())
    return pa.Array.from_buffers(pa.date32(), len(days), [None, pa.py_buffer(days)])


def _thousandths(column: pa.Array) -> np.ndarray:
    """A column of decimal(18,3), which fits 64 bits, in thousandths; 0 for null."""
    out = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset : 2 * (column.offset + len(column)) : 2]
    return np.where(column.is_null().to_numpy(zero_copy_only=False), 0, out) if column.null_count else out


def _decimals(milli: np.ndarray) -> pa.Array:
    """Thousandths, none negative, as decimal(28,3)."""
    words = np.zeros((len(milli), 2), np.int64)
    words[:, 0] = milli
    return pa.Array.from_buffers(pa.decimal128(28, 3), len(milli), [None, pa.py_buffer(words)])


@udtf(returnType="sku string, engine string, h int, yhat double")
class ForecastRows:
    """A forecast of one item's demand, by engine TSB or MEAN, for the periods after its last; the rows must come by period."""

    def __init__(self):
        self.y, self.sku = [], None

    def eval(self, engine: str, horizon: int, row):
        self.sku, self.engine, self.horizon = row["sku"], engine, horizon
        self.y.append(float(row["demand"] or 0))

    def terminate(self):
        if not self.y:
            return
        if self.engine == "TSB":
            p, z = P.start_probability, next((v for v in self.y if v > 0), 0.0)
            for v in self.y:
                p += P.alpha * ((1.0 if v > 0 else 0.0) - p)
                z = z + P.beta * (v - z) if v > 0 else z
            value = p * z
        elif self.engine == "MEAN":
            value = sum(self.y) / len(self.y)
        else:
            raise ValueError(f"engine must be TSB or MEAN, not {self.engine}")
        for h in range(1, self.horizon + 1):
            yield self.sku, self.engine, h, round(value, 4)


def register_sql(spark: SparkSession, pov: DataFrame, grn: DataFrame, stock: DataFrame, p: Params = P) -> None:
    """Views pov, grn, stock, demand and moves (orders and receipts in one), and the functions fifo and forecast."""
    def side(df: DataFrame, date: str, receipt: bool) -> DataFrame:
        return df.select("sku", F.lit(receipt).alias("receipt"), F.col(date).alias("move_date"), F.col("qty").cast("decimal(18,3)").alias("qty"), "src_file", "src_row", "line_no", "vendor", "amount")

    views = {"pov": pov, "grn": grn, "stock": stock, "demand": demand_balance(stock, grn, p.bucket), "moves": side(pov, "order_date", False).unionByName(side(grn, "receipt_date", True))}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    spark.udtf.register("fifo", FifoRows)
    spark.udtf.register("forecast", ForecastRows)
