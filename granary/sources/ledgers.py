"""Typed ledgers from ERP exports: .csv and .xlsx files with padding rows, messy headers and unlike layouts.

All files of a ledger are one scan by the data source of ``scan``: each file finds its own header row by matching names
against an alias table, maps its columns to the ledger's schema, and types its cells, deciding decimal marks and the order of day and month by
column. Rows with a required value missing or any value that cannot be typed carry a reason and go to a second frame, and so do sheets
without a header row in a workbook that has others with one. A purchase order's missing amount is its quantity times its rate.
The typed rows are written once to the shared folder, so nothing that is computed from them opens a file again.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.staging import staged
from granary.sources.values import BLANKS, COMMA, POINT, UNSURE


@dataclass(frozen=True)
class Reading:
    """How files are read where they don't say themselves."""

    look_ahead: int = 25  # rows searched for a header
    mark: str = "."  # decimal mark of numbers in columns that don't decide it
    first: str = "day"  # what comes first, day or month, in columns that don't decide it
    separator: str | None = None  # of .csv cells; found by the header if None
    encoding: str | None = None  # of .csv files; found by mark of order and by content if None


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    aliases: tuple[str, ...]
    required: bool = False


SKU = Field("sku", "string", ("sku", "item", "item_code", "item_no", "material", "part_no", "product_code", "stock_item"), True)
VENDOR = Field("vendor", "string", ("vendor", "supplier", "vendor_name", "supplier_name", "party", "party_name"))
QTY = Field("qty", "decimal(18,3)", ("qty", "quantity", "order_qty", "ordered_qty", "received_qty", "billed_qty", "closing_qty"), True)
AMOUNT = Field("amount", "decimal(18,2)", ("amount", "value", "total", "line_value", "net_amount"))
LEDGERS: dict[str, tuple[Field, ...]] = {
    "pov": (
        Field("po_id", "string", ("po_id", "po_no", "po_number", "order_no", "voucher_no")),
        Field("line_no", "int", ("line_no", "line", "sl_no", "s_no")),
        SKU,
        VENDOR,
        Field("order_date", "date", ("order_date", "po_date", "date", "voucher_date"), True),
        QTY,
        Field("rate", "decimal(18,2)", ("rate", "price", "unit_price")),
        AMOUNT,
    ),
    "grn": (
        Field("grn_id", "string", ("grn_id", "grn_no", "receipt_no", "voucher_no")),
        Field("line_no", "int", ("line_no", "line", "sl_no", "s_no")),
        SKU,
        VENDOR,
        Field("receipt_date", "date", ("receipt_date", "grn_date", "received_date", "date"), True),
        QTY,
        AMOUNT,
    ),
    "pv": (
        Field("pv_id", "string", ("pv_id", "pv_no", "invoice_no", "bill_no", "voucher_no")),
        VENDOR,
        Field("invoice_date", "date", ("invoice_date", "pv_date", "bill_date", "date"), True),
        SKU,
        QTY,
        AMOUNT,
    ),
    "stock": (SKU, Field("as_of", "date", ("as_of", "as_on", "stock_date", "closing_date", "date"), True), QTY, Field("value", "decimal(18,2)", ("value", "amount", "closing_value"))),
}


class LedgerError(ValueError):
    """A file that cannot be read as the ledger it is given as."""


def normalise(header: str | None) -> str:
    return re.sub(r"[^a-z0-9]+", "_", (header or "").strip().lower()).strip("_")


def map_header(kind: str, names: list[str | None]) -> dict[str, int]:
    """Ledger field to column index; an alias counts once, in the order of the alias table."""
    known = [normalise(n) for n in names]
    out: dict[str, int] = {}
    for field in LEDGERS[kind]:
        for alias in field.aliases:
            if alias in known and known.index(alias) not in out.values():
                out[field.name] = known.index(alias)
                break
    return out


def find_header(kind: str, rows: list[list[str | None]]) -> tuple[int, dict[str, int]]:
    """The row that names most fields, all required ones among them."""
    found = [(len(m), -i, m) for i, row in enumerate(rows) if all(f.name in (m := map_header(kind, row)) for f in LEDGERS[kind] if f.required)]
    if not found:
        need = ", ".join(f.name for f in LEDGERS[kind] if f.required)
        raise LedgerError(f"no header row with {need} among the first {len(rows)} rows")
    n, i, m = max(found, key=lambda x: x[:2])
    return -i, m


def typed(cell: Column, kind: str, reading: Reading = Reading()) -> Column:
    """A text cell as a column expression, for streams: what a file decides by column, ``reading`` decides here."""
    text = F.nullif(F.trim(cell), F.lit(""))
    if kind == "string":
        return text
    if kind == "date":
        t = F.regexp_replace(text, r"[T ]+\d{1,2}:\d{2}.*$", "")
        t = F.regexp_replace(t, r"[./]", "-")
        year_last = ("d-M-yyyy", "M-d-yyyy") if reading.first == "day" else ("M-d-yyyy", "d-M-yyyy")
        serial = F.when(t.rlike(r"^[0-9]{5}(-[0-9]+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.substring(t, 1, 5).cast("int")))
        compact = F.when(t.rlike(r"^[0-9]{8}$"), F.try_to_date(t, "yyyyMMdd"))
        other = F.when(~t.rlike(r"^[0-9]+(-[0-9]+)?$"), F.coalesce(*[F.try_to_date(t, f) for f in ("yyyy-M-d", *year_last, "d-MMM-yyyy")]))
        return F.coalesce(serial, compact, other)
    return plain_number(text, reading.mark).try_cast(kind)


def plain_number(text: Column, mark: str = ".") -> Column:
    """A number's text with a decimal point only; what can be read in two ways is read with ``mark``, what in none fails to be typed."""
    t = F.regexp_replace(text, BLANKS, "")
    t = F.regexp_replace(t, r"^\((.*)\)$|^(.+)-$", "-$1$2")
    points, commas = F.regexp_replace(t, ",", ""), F.translate(F.regexp_replace(t, r"\.", ""), ",", ".")
    return F.when(t.rlike(UNSURE), points if mark == "." else commas).when(t.rlike(POINT), points).when(t.rlike(COMMA), commas).otherwise(t)


def check_size(spark: SparkSession, path: str, caps: dict[str, int] | None) -> None:
    """Raises if a file is larger than its extension's cap in bytes."""
    cap = (caps or {}).get(path.rsplit(".", 1)[-1].lower())
    if cap is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    if size > cap:
        raise LedgerError(f"{path} has {size} bytes; the cap is {cap}")


def _type(kind: str) -> T.DataType:
    """The type of a field, without a session: tasks ask for it too."""
    if kind.startswith("decimal"):
        return T.DecimalType(*map(int, kind[8:-1].split(",")))
    return {"string": T.StringType(), "int": T.IntegerType(), "date": T.DateType()}[kind]


def schema_of(kind: str) -> T.StructType:
    """The columns of a scan: the ledger's fields, where a row comes from, and why it is rejected."""
    fields = [T.StructField(f.name, _type(f.kind)) for f in LEDGERS[kind]]
    return T.StructType([*fields, T.StructField("src_file", T.StringType()), T.StructField("src_row", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("cells", T.ArrayType(T.StringType()))])


def load_ledger(spark: SparkSession, kind: str, paths: list[str], caps: dict[str, int] | None = None, reading: Reading = Reading()) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of all files of one ledger, read once. A path may be a folder or a glob."""
    from granary.sources.scan import check_kind, expanded, scan

    paths = [p for path in paths for p in ([path] if path.lower().endswith((".csv", ".xlsx", ".xls")) and "*" not in path else expanded(spark, path))]
    for path in paths:
        check_kind(path)
    if not paths:
        read = spark.createDataFrame([], schema_of(kind))
    else:
        if caps:
            with ThreadPoolExecutor(min(8, len(paths))) as pool:
                list(pool.map(lambda path: check_size(spark, path, caps), paths))
        try:
            read = staged(scan(spark, kind, paths, reading), f"ledger-{kind}")
        except PySparkException as e:
            if found := re.search(r"LedgerError: (.*)", str(e)):
                raise LedgerError(found[1]) from e
            raise
    rejects = read.where("reason is not null").select("src_file", "src_row", "reason", "cells")
    return read.where("reason is null").drop("reason", "cells"), rejects
