import zipfile
from decimal import Decimal

import pytest

from granary.api import process_multiledger
from granary.sources.ledgers import LedgerError, load_ledger


def xlsx(path, rows):
    def cell(v):
        return f"<c><v>{v}</v></c>" if isinstance(v, int | float) else "<c/>" if v is None else f'<c t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "pov1.csv").write_text("Report,,,,\n,,,,\n PO No , Item Code,Supplier Name,PO Date, Qty ,Amount\n1,A,Acme,05/01/2020,10,\"1,234.50\"\n2,B,acme.,06/02/2020,4,80\n3,,Acme,06/02/2020,4,80\n")
    xlsx(tmp_path / "pov2.xlsx", [["Title"], [], ["Quantity", "SKU", "Order Date", "Vendor", "Amount"], [3, "A", 43862, "ACME", 30.25], ["x", "A", 43862, "ACME", 1]])
    (tmp_path / "grn.csv").write_text("sku,qty,receipt date,vendor\nA,12,2020-01-20,Acme\nB,4,2020-03-01,Acme\n")
    (tmp_path / "stock.csv").write_text("item,closing date,closing qty\nA,31-01-2020,5\nA,29-02-2020,2\nB,31-01-2020,1\nB,31-03-2020,0\n")
    return tmp_path


def test_messy_files_become_typed_rows(spark, files):
    rows, rejects = load_ledger(spark, "pov", [str(files / "pov1.csv"), str(files / "pov2.xlsx")])
    got = sorted((r.sku, r.order_date.isoformat(), r.qty, r.amount) for r in rows.collect())
    assert got == [("A", "2020-01-05", Decimal("10.000"), Decimal("1234.50")), ("A", "2020-02-01", Decimal("3.000"), Decimal("30.25")), ("B", "2020-02-06", Decimal("4.000"), Decimal("80.00"))]
    assert sorted(r.reason for r in rejects.collect()) == ["missing or unreadable: qty", "missing or unreadable: sku"]


def test_errors_are_clear(spark, files):
    (files / "old.xls").write_bytes(b"x")
    (files / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(LedgerError, match="xls"):
        load_ledger(spark, "pov", [str(files / "old.xls")])
    with pytest.raises(LedgerError, match="no header"):
        load_ledger(spark, "pov", [str(files / "bad.csv")])
    with pytest.raises(LedgerError, match="cap"):
        load_ledger(spark, "pov", [str(files / "pov1.csv")], caps={"csv": 10})


def test_process_multiledger(spark, files):
    out = process_multiledger(spark, [str(files / "pov1.csv"), str(files / "pov2.xlsx")], [str(files / "grn.csv")], [str(files / "stock.csv")])
    assert {
        "abc_data", "historical_data", "supplier_data", "lead_time_data", "top10_trends", "sbc_data", "abc_distribution", "supplier_clusters", "forecast_compare",
        "forecast_errors", "demand_history",
    } <= set(out)
    assert {r.vendor for r in out["supplier_data"].collect()} == {"ACME"}
    metrics = {r.sku: r for r in out["sku_metrics"].collect()}
    assert metrics["A"].pending_qty == 1 and metrics["B"].pending_qty == 0
    assert out["historical_data"].count() == 3 + 2 + 4
    assert out["rejects"].count() == 2


def test_numbers(spark):
    from pyspark.sql import functions as F

    from granary.sources.ledgers import typed

    cases = {"1,234.50": 1234.5, "1.234,50": 1234.5, "12,34,567.25": 1234567.25, "1 234": 1234, "0,5": 0.5, "1.5": 1.5, "1,234": 1234, "1.234.567": 1234567, "-3": -3, "oops": None, "1,2,3": None}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", typed(F.col("c"), "decimal(18,2)").alias("v"))
    assert {r.c: None if r.v is None else float(r.v) for r in df.collect()} == cases


def test_unreadable_optional_values_and_wide_files(spark, tmp_path):
    wide = ",".join(f"x{i}" for i in range(80))
    (tmp_path / "w.csv").write_text(f"{wide},sku,order date,qty,rate,amount\n" + "".join(f"{',' * 80}{row}\n" for row in ("A,2020-01-01,2,1.5,", "B,2020-01-01,2,,oops", "C,2020-01-01,3,,7")))
    rows, rejects = load_ledger(spark, "pov", [str(tmp_path / "w.csv")])
    assert sorted((r.sku, float(r.amount)) for r in rows.collect()) == [("A", 3.0), ("C", 7.0)]
    assert [r.reason for r in rejects.collect()] == ["missing or unreadable: amount"]


def test_all_sheets_of_a_workbook(spark, tmp_path):
    def sheet(rows):
        body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r) + "</row>" for r in rows)
        return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'

    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr(
            "xl/workbook.xml",
            '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="May" r:id="r2"/><sheet name="Notes" r:id="r3"/><sheet name="April" r:id="r1"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2, 3)) + "</Relationships>",
        )
        z.writestr("xl/worksheets/sheet1.xml", sheet([["sku", "qty", "receipt date"], ["A", "1", "2020-04-01"]]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([["title"], ["qty", "sku", "receipt date"], ["2", "B", "2020-05-01"]]))
        z.writestr("xl/worksheets/sheet3.xml", sheet([["call them"]]))
    rows, rejects = load_ledger(spark, "grn", [str(tmp_path / "b.xlsx")])
    assert sorted((r.sku, int(r.qty)) for r in rows.collect()) == [("A", 1), ("B", 2)]
    assert [r.reason.split(":")[0] for r in rejects.collect()] == ["sheet Notes"]
