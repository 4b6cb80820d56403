"""Ledgers derived from the order tables, in Spark and as SQL with the same rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import staging
from granary.functions.staging import shared_dir

QUARTERS = 27  # 1995-01 to 2001-09
FIRST = 1995 * 4  # the first quarter's running number
PARTS = 50_000  # parts whose snapshots one task makes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pov(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    n = lines.count()
    if n > staging.TASK_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions")):  # else a task sorts no more as it is
        lines, orders = staging.dealt(lines, n, "l_orderkey"), staging.dealt(orders, n, "o_orderkey")
    j = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return j.select(
        F.col("l_orderkey").cast("string").alias("po_id"),
        F.col("l_linenumber").cast("int").alias("line_no"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.col("l_suppkey").cast("string").alias("vendor"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("l_quantity").cast("decimal(18,3)").alias("qty"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.lit("lineitem").alias("src_file"),
        F.col("l_orderkey").alias("src_row"),
    )


def grn(orders: DataFrame) -> DataFrame:
    some = orders.where((F.col("src_row") * 3 + F.col("line_no")) % 10 < 8)
    days = ((F.col("src_row") * 7 + F.col("line_no") * 13) % 45 + 1).cast("int")
    return some.select(F.col("po_id").alias("grn_id"), "line_no", "sku", "vendor", F.date_add("order_date", days).alias("receipt_date"), "qty", "amount", "src_file", "src_row")


def pv(receipts: DataFrame) -> DataFrame:
    return receipts.select(F.col("grn_id").alias("pv_id"), "vendor", F.date_add("receipt_date", 7).alias("invoice_date"), "sku", "qty", "amount", "src_file", "src_row")


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey")
    # The part table is one small file, that is one task, however many snapshots it is about to become.
    parts = parts.repartition(parts.count() // PARTS + 1, "p_partkey").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(QUARTERS - 1))))
    last = F.date_sub(F.add_months(F.lit("1995-04-01").cast("date"), F.col("i") * 3), 1)
    qty = ((F.col("p_partkey") * 31 + F.col("i") * 17) % 40).cast("decimal(18,3)")
    return parts.select(
        F.col("p_partkey").cast("string").alias("sku"), last.alias("as_of"), qty.alias("qty"), F.lit(None).cast("decimal(18,2)").alias("value"),
        F.lit("part").alias("src_file"), F.col("i").cast("long").alias("src_row"),
    )


def sparse(stock: DataFrame) -> DataFrame:
    """The snapshots that are left when a quarter of them, another one for each part, was not taken."""
    return stock.where((F.col("sku").cast("long") + F.col("src_row")) % 4 != 1)


def one_hot_item(ledger: DataFrame) -> DataFrame:
    """Half of all rows belong to one item."""
    return ledger.withColumn("sku", F.when((F.col("src_row") + F.col("line_no")) % 2 == 0, F.lit("HOT")).otherwise(F.col("sku")))


def exports(spark: SparkSession, sf_dir: str) -> list[str]:
    """Folders of .csv files with the purchase orders, an order's last digits deciding among four layouts: names and order of
    columns, separator, form of dates and of numbers."""
    rows = pov(spark, sf_dir)
    money = F.format_number("amount", 2)
    layouts = (
        (",", {"PO No": "po_id", "Line": "line_no", "Item Code": "sku", "Supplier Name": "vendor", "PO Date": F.date_format("order_date", "dd/MM/yyyy"), "Ordered Qty": "qty", "Net Amount": money}),
        (
            ";",
            {
                "Amount": F.translate(money, ",.", ".,"), "Quantity": F.concat(F.col("qty").cast("long"), F.lit(",0")),
                "Order Date": F.date_format("order_date", "dd.MM.yyyy"), "Material": "sku", "Party": "vendor", "S. No": "line_no", "Voucher No": "po_id",
            },
        ),
        (
            "\t",
            {
                " sku ": "sku", "QTY": "qty", "date": F.concat(F.date_format("order_date", "yyyy-MM-dd"), F.lit(" 08:30:00")), "vendor": "vendor", "value": "amount",
                "order no": "po_id", "sl_no": "line_no", "remarks": F.lit("none"),
            },
        ),
        ("|", {"Order Date": F.date_format("order_date", "yyyyMMdd"), "po_number": "po_id", "part no": "sku", "supplier": "vendor", "line": "line_no", "order qty": "qty", "total": "amount"}),
    )
    folder, out = f"{shared_dir(spark)}/exports-{uuid.uuid4().hex}", []
    for i, (separator, columns) in enumerate(layouts):
        out.append(f"{folder}/{i}")
        shown = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
        rows.where(F.col("src_row") % 4 == i).select(*shown).write.option("header", True).option("sep", separator).option("ignoreLeadingWhiteSpace", False).csv(out[-1])
    return out


def messy_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spellings of every supplier."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").withColumn("v", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    name = F.when(F.col("v") == 0, F.col("s_name")).when(F.col("v") == 1, F.concat(F.lit("  "), F.lower("s_name"), F.lit("."))).otherwise(F.regexp_replace("s_name", "#", " - "))
    return s.select(F.col("s_suppkey").alias("vendor_id"), F.col("v").alias("spelling"), name.alias("vendor_name"))


def misspelt_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four spellings of every supplier under an invented name of 14 letters: right, in another case with a mark, a letter lost, a letter wrong."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.translate(F.substring(F.md5(F.col("s_name").cast("binary")), 1, 14), "0123456789", "ghijklmnop").alias("n"))
    s = s.withColumn("v", F.explode(F.array(*map(F.lit, (0, 1, 2, 3)))))
    cut = lambda a, n: F.substring("n", a, n)
    name = F.when(F.col("v") == 0, F.col("n")).when(F.col("v") == 1, F.concat(F.upper(cut(1, 6)), F.lit(" - "), cut(7, 8)))
    name = name.when(F.col("v") == 2, F.concat(cut(1, 4), cut(6, 9))).otherwise(F.concat(cut(1, 7), F.lit("z"), cut(9, 6)))
    return s.select(F.col("s_suppkey").alias("vendor_id"), F.col("v").alias("spelling"), name.alias("vendor_name"))


def item_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sku"), F.col("p_brand").alias("item_group"))


def quarters(spark: SparkSession) -> DataFrame:
    """(t, begins, ends) of the quarters that the fixtures cover."""
    begins = F.add_months(F.lit("1995-01-01").cast("date"), F.col("id").cast("int") * 3)
    return spark.range(QUARTERS).select((F.col("id") + FIRST).cast("int").alias("t"), begins.alias("begins"), F.add_months(begins, 3).alias("ends"))


SQL = """
WITH pov AS (
  SELECT CAST(l_partkey AS VARCHAR) AS sku, CAST(l_suppkey AS VARCHAR) AS vendor, CAST(o_orderdate AS DATE) AS order_date,
         CAST(l_quantity AS DECIMAL(18,3)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_orderkey AS po, l_linenumber AS ln
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
grn AS (
  SELECT sku, vendor, order_date + CAST((po * 7 + ln * 13) % 45 + 1 AS INTEGER) AS receipt_date, qty, amount, po, ln
  FROM pov WHERE (po * 3 + ln) % 10 < 8),
quarters AS (SELECT CAST(range AS INTEGER) AS i FROM range(27)),
stock AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sku, i, 7980 + i AS t, CAST((p_partkey * 31 + i * 17) % 40 AS DECIMAL(18,3)) AS qty
  FROM part CROSS JOIN quarters),
received AS (
  SELECT sku, CAST(year(receipt_date) * 4 + quarter(receipt_date) - 1 AS INTEGER) AS t, sum(qty) AS receipts FROM grn GROUP BY ALL),
balance AS (
  SELECT s.sku, s.t, lag(s.qty) OVER (PARTITION BY s.sku ORDER BY s.t) AS opening, s.qty AS closing, coalesce(receipts, 0) AS receipts
  FROM stock s LEFT JOIN received r ON r.sku = s.sku AND r.t = s.t),
demand AS (
  SELECT sku, t, CAST(greatest(opening + receipts - closing, 0) AS DECIMAL(28,3)) AS demand, CAST(opening + receipts - closing < 0 AS INTEGER) AS negative
  FROM balance WHERE opening IS NOT NULL),
moments AS (
  SELECT sku, count(*) AS n_periods, count(*) FILTER (demand > 0) AS n_demands, sum(CAST(demand AS DOUBLE)) AS total,
         sum(CAST(demand AS DOUBLE) * CAST(demand AS DOUBLE)) AS squares FROM demand GROUP BY sku),
shapes AS (
  SELECT sku, n_periods, n_demands, total, CASE WHEN n_demands > 0 THEN round(n_periods / n_demands, 6) END AS adi,
         CASE WHEN total > 0 THEN round((n_demands * squares - total * total) / (total * total), 6) END AS cv2 FROM moments),
classes AS (
  SELECT *, CASE WHEN n_demands = 0 THEN 'NoDemand' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'Smooth' WHEN adi < 1.32 THEN 'Erratic'
                 WHEN cv2 < 0.49 THEN 'Intermittent' ELSE 'Lumpy' END AS sbc FROM shapes)
"""

_CLASSES = SQL.index("moments AS")
#: The same from sparse snapshots: gap_demand, and classes made of it.
SPARSE_SQL = (
    SQL[:_CLASSES]
    + """sparse AS (SELECT sku, t, qty FROM stock WHERE (CAST(sku AS BIGINT) + i) % 4 <> 1),
spans AS (SELECT sku, t, qty AS closing, lag(qty) OVER w AS opening, lag(t) OVER w AS since FROM sparse WINDOW w AS (PARTITION BY sku ORDER BY t)),
balances AS (
  SELECT s.sku, s.t, since, opening + coalesce(sum(receipts), 0) - closing AS balance
  FROM spans s LEFT JOIN received r ON r.sku = s.sku AND r.t > since AND r.t <= s.t WHERE opening IS NOT NULL GROUP BY s.sku, s.t, since, opening, closing),
spread AS (SELECT sku, t, since, balance, CAST(greatest(balance, 0) * 1000 AS BIGINT) AS milli, unnest(generate_series(since + 1, t)) AS p FROM balances),
gap_demand AS (
  SELECT sku, CAST(p AS INTEGER) AS t, (CASE WHEN p < t THEN milli // (t - since) ELSE milli - (milli // (t - since)) * (t - since - 1) END) / 1000.0 AS demand,
         CAST(p = t AND balance < 0 AS INTEGER) AS negative FROM spread),
"""
    + SQL[_CLASSES:].replace("FROM demand GROUP", "FROM gap_demand GROUP")
)
