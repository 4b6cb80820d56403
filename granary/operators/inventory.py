"""FIFO matching, implied demand and inventory metrics. Formulas that the requirements leave open are marked assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.segmented import segmented
from granary.functions.staging import dealt
from granary.params import Params


def period(date: str | Column, bucket: str = "quarter") -> Column:
    """A running number of the month or quarter."""
    return F.year(date) * 4 + F.quarter(date) - 1 if bucket == "quarter" else F.year(date) * 12 + F.month(date) - 1


def fifo_match(pov: DataFrame, grn: DataFrame, keys: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """(keys, order_date, receipt_date, matched): receipts matched to orders first in, first out.

    Orders and receipts are laid end to end by quantity. Their right ends, sorted together, cut the quantity axis
    into pieces that each belong to one order and one receipt: the next ends to the right. That is one sort of
    |orders| + |receipts| rows per key, where an overlap join would pair them all before it filters.

    rows: about how many either ledger has, so that what a task sorts doesn't grow with them.
    """
    keys = keys or ["sku"]

    def placed(df: DataFrame, n: int) -> DataFrame:
        return df if rows is None else dealt(df, n * rows, *keys)

    def ends(df: DataFrame, date: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(date, "src_file", "src_row", "line_no", "vendor", "qty", "amount").rowsBetween(Window.unboundedPreceding, 0)
        return placed(df.where("qty > 0"), 1).withColumn("end", F.sum("qty").over(order).cast("decimal(28,3)"))

    o = ends(pov, "order_date").select(*keys, "end", "order_date", F.lit(None).cast("date").alias("receipt_date"))
    r = ends(grn, "receipt_date").select(*keys, "end", F.lit(None).cast("date").alias("order_date"), "receipt_date")
    falling = Window.partitionBy(*keys).orderBy(F.desc("end"), F.col("order_date").isNull())
    so_far = falling.rowsBetween(Window.unboundedPreceding, 0)
    cut = placed(o.unionByName(r), 2).select(
        *keys,
        F.last("order_date", ignorenulls=True).over(so_far).alias("order_date"),
        F.last("receipt_date", ignorenulls=True).over(so_far).alias("receipt_date"),
        (F.col("end") - F.coalesce(F.lead("end").over(falling), F.lit(0))).alias("matched"),
    )
    return cut.where("matched > 0 and order_date is not null and receipt_date is not null")


def fifo_match_spread(pov: DataFrame, grn: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What fifo_match returns, with no key in one task: its running totals and its sweep over the quantity axis are scans whose
    parts are cut by order, not by key. It costs two range partitionings with a write each, so it is for ledgers where one key holds
    more rows than a task should."""
    keys = keys or ["sku"]

    def side(df: DataFrame, date: str, receipt: bool) -> DataFrame:
        tie = F.struct(F.col(date).alias("date"), "src_file", "src_row", "line_no", "vendor", "qty", "amount")
        dates = (F.lit(None).cast("date"), F.col(date)) if receipt else (F.col(date), F.lit(None).cast("date"))
        columns = [F.col(k).alias(f"key_{k}") for k in keys]
        return df.where("qty > 0").select(
            *columns, F.lit(receipt).alias("receipt"), tie.alias("place"), F.col("qty").cast("decimal(28,3)").alias("qty"), dates[0].alias("ordered"),
            dates[1].alias("received"),
        )

    own = [f"key_{k}" for k in keys]
    moves = side(pov, "order_date", False).unionByName(side(grn, "receipt_date", True))
    ends = segmented(moves, [*own, "receipt"], [F.col("place")], sums={"end": "qty"}).drop("place", "qty", "part")
    ends = ends.withColumns({"end": F.col("end").cast("decimal(28,3)"), "_r": F.col("receipt").cast("int")})
    swept = segmented(ends, own, [F.desc("end"), F.col("_r")], lasts={"order_date": "ordered", "receipt_date": "received"}, nexts={"below": "end"})
    cut = swept.select(*[F.col(f"key_{k}").alias(k) for k in keys], "order_date", "receipt_date", (F.col("end") - F.coalesce("below", F.lit(0))).alias("matched"), "part")
    return cut.where("matched > 0 and order_date is not null and receipt_date is not null")


def lead_times(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Quantity-weighted days from order to receipt; quantity matched to a later order is counted, not hidden."""
    keys = keys or ["sku"]
    days = F.datediff("receipt_date", "order_date")
    return matches.groupBy(*keys).agg(
        F.sum("matched").cast("decimal(28,3)").alias("matched_qty"),
        F.round((F.sum(F.col("matched") * days) / F.sum("matched")).cast("double"), 6).alias("lead_time_days"),
        F.coalesce(F.sum(F.when(days < 0, F.col("matched"))), F.lit(0)).cast("decimal(28,3)").alias("early_qty"),
    )


def pending(pov: DataFrame, grn: DataFrame) -> DataFrame:
    """Ordered less received, at least 0 (assumed); receipts beyond orders are shown apart."""
    moves = pov.select("sku", F.col("qty").alias("ordered"), F.lit(0).cast("decimal(18,3)").alias("received")).unionByName(grn.select("sku", F.lit(0).cast("decimal(18,3)").alias("ordered"), F.col("qty").alias("received")))
    sums = moves.groupBy("sku").agg(F.sum("ordered").cast("decimal(28,3)").alias("ordered"), F.sum("received").cast("decimal(28,3)").alias("received"))
    zero = F.lit(0).cast("decimal(28,3)")
    return sums.withColumns({"pending_qty": F.greatest(F.col("ordered") - F.col("received"), zero).cast("decimal(28,3)"), "received_without_po": F.greatest(F.col("received") - F.col("ordered"), zero).cast("decimal(28,3)")})


def demand_balance(stock: DataFrame, grn: DataFrame, bucket: str = "quarter") -> DataFrame:
    """(sku, t, demand, negative): between two snapshots of an item, opening stock plus all receipts after the first and up to
    the second less closing stock; a negative balance counts as 0 and is flagged in the closing period (assumed).

    Snapshots may leave periods out: the balance is then spread evenly over the periods since the last one, what thousandths
    are left over going to the closing period (assumed), so every calendar period from an item's first snapshot to its last has a
    row. Receipts up to the first snapshot are part of its stock; those after the last wait for the next one.
    """
    closing = stock.select("sku", period("as_of", bucket).alias("t"), F.struct("as_of", "src_row", "qty").alias("last"), F.lit(None).cast("decimal(28,3)").alias("got"))
    # A hot item's receipts are summed before they meet. The largest struct is found by sorting, so snapshots are dealt out by item first,
    # and all steps from here to the end stay where the items are, in tasks whose size doesn't depend on the table's.
    receipts = grn.groupBy("sku", period("receipt_date", bucket).alias("t")).agg(F.sum("qty").cast("decimal(28,3)").alias("got"))
    receipts = receipts.select("sku", "t", F.lit(None).cast(closing.schema["last"].dataType).alias("last"), "got")
    moves = dealt(closing.unionByName(receipts), stock.count(), "sku").groupBy("sku", "t").agg(F.max("last").alias("last"), F.coalesce(F.sum("got"), F.lit(0)).cast("decimal(28,3)").alias("got"))
    by_sku = Window.partitionBy("sku").orderBy("t")
    ends = F.min(F.when(F.col("last").isNotNull(), F.col("t"))).over(by_sku.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    spans = moves.withColumn("end", ends).where("end is not null").groupBy("sku", F.col("end").alias("t"))
    spans = spans.agg(F.max("last.qty").alias("closing"), F.sum("got").alias("got"))
    spans = spans.withColumns({"opening": F.lag("closing").over(by_sku), "before": F.lag("t").over(by_sku)}).where("opening is not null")
    balance = F.col("opening") + F.col("got") - F.col("closing")
    milli = F.greatest(balance * 1000, F.lit(0)).cast("long")
    even = F.expr("milli div (end - before)")
    spread = spans.select("sku", F.col("t").alias("end"), "before", milli.alias("milli"), balance.alias("balance"))
    spread = spread.withColumn("t", F.explode(F.sequence(F.col("before") + 1, F.col("end"))))
    own = F.when(F.col("t") < F.col("end"), even).otherwise(F.col("milli") - even * (F.col("end") - F.col("before") - 1))
    flag = ((F.col("t") == F.col("end")) & (F.col("balance") < 0)).cast("int")
    return spread.select("sku", "t", (own.cast("decimal(25,0)") / 1000).cast("decimal(28,3)").alias("demand"), flag.alias("negative"))


def on_hand(stock: DataFrame) -> DataFrame:
    return stock.groupBy("sku").agg(F.max_by("qty", F.struct("as_of", "src_row")).cast("decimal(28,3)").alias("on_hand"))


def trend(demand: DataFrame) -> DataFrame:
    """Slope of demand per period over its mean (assumed), from sums."""
    d, t = F.col("demand").cast("double"), F.col("t").cast("double")
    base = demand.groupBy("sku").agg(
        F.count("*").cast("double").alias("n"), F.sum(t).alias("st"), F.sum(t * t).alias("stt"), F.sum(d).alias("sd"), F.sum(t * d).alias("std"),
        F.sum("demand").cast("decimal(28,3)").alias("total_demand"), F.sum("negative").cast("long").alias("n_negative"),
    )
    spread = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    slope = (F.col("n") * F.col("std") - F.col("st") * F.col("sd")) / spread
    factor = F.when((spread > 0) & (F.col("sd") > 0), F.round(slope / (F.col("sd") / F.col("n")), 6))
    return base.select("sku", "total_demand", "n_negative", factor.alias("trend_factor"))


def sku_metrics(pov: DataFrame, grn: DataFrame, stock: DataFrame, p: Params = Params()) -> DataFrame:
    """Per item: lead time, total demand, pending, unordered (demand less stock and pending, at least 0; assumed), trend."""
    t = trend(demand_balance(stock, grn, p.bucket))
    out = pending(pov, grn).join(on_hand(stock), "sku", "full").join(t, "sku", "full").join(lead_times(fifo_match(pov, grn)), "sku", "left")
    gap = F.coalesce("total_demand", F.lit(0)) - F.coalesce("on_hand", F.lit(0)) - F.coalesce("pending_qty", F.lit(0))
    return out.withColumn("unordered_qty", F.greatest(gap, F.lit(0)).cast("decimal(28,3)")).select(
        "sku", "total_demand", "n_negative", "on_hand", "pending_qty", "received_without_po", "unordered_qty", "lead_time_days", "early_qty", "trend_factor",
    )
