"""Values, layouts and the ledger data source."""

import zipfile
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from granary.sources.files import encoding_of
from granary.sources.ledgers import LedgerError, Reading, load_ledger, typed
from granary.sources.scan import register, scan
from granary.sources.values import Habits, Number, day, number

NUMBERS = {
    "0,500": "0.5", "-0,125": "-0.125", "00,125": "0.125", "1234,567": "1234.567", "1.234.567": "1234567", "12,34,567.25": "1234567.25", "1,234,567": "1234567", "(1,234.50)": "-1234.5",
    "17,5-": "-17.5", "1 234,5": "1234.5", "1'234.5": "1234.5", ".5": "0.5", ",5": "0.5", "5.": "5", "0.500": "0.5", "1,2,3": None, "01,234.5": None, "oops": None, "": None, "--1": None, "1.2.3": None,
}


def test_numbers_that_can_be_read_in_one_way_only(spark):
    for text, want in NUMBERS.items():
        for mark in ".,":
            assert number(text, mark, 3) == (None if want is None else Decimal(want).quantize(Decimal("0.001"))), text
    df = spark.createDataFrame([(k,) for k in NUMBERS], "c string")
    for mark in ".,":  # the same as a column, for streams
        got = {r.c: r.v for r in df.select("c", typed(F.col("c"), "decimal(18,3)", Reading(mark=mark)).alias("v")).collect()}
        assert got == {k: None if v is None else Decimal(v).quantize(Decimal("0.001")) for k, v in NUMBERS.items()}


def test_a_column_decides_its_mark():
    assert number("1,234", ".", 3) == 1234 and number("1,234", ",", 3) == Decimal("1.234")
    assert number("1.234", ".", 3) == Decimal("1.234") and number("1.234", ",", 3) == 1234
    h = Habits()
    for t in ("1.234,50", "1,234", "7"):
        h.see_number(t)
    assert h.mark(".") == ","
    h.see_number("12,345.5")  # evidence of both kinds
    assert h.mark(".") == "." and h.mark(",") == ","
    assert number(Number("1.234"), ",", 3) == Decimal("1.234") and number(Number("2.5E-2"), ",", 3) == Decimal("0.025")
    assert number("9" * 16, ".", 3) is None  # more than 18 digits
    assert number("1.0005", ".", 3) == Decimal("1.001") and number("-1.0005", ".", 3) == Decimal("-1.001")


def test_dates(spark):
    cases = {
        "2020-01-31": (2020, 1, 31), "20200131": (2020, 1, 31), "2020/1/5 07:45": (2020, 1, 5), "2020-01-31T10:00:00Z": (2020, 1, 31), "31.01.2020": (2020, 1, 31), "01/31/2020": (2020, 1, 31), "05-Feb-2020": (2020, 2, 5),
        "43862": (2020, 2, 1), "2020": None, "1234": None, "99": None, "2020-13-01": None, "31/31/2020": None, "": None,
    }
    for first in ("day", "month"):
        df = spark.createDataFrame([(k,) for k in cases], "c string")
        got = {r.c: r.v for r in df.select("c", typed(F.col("c"), "date", Reading(first=first)).alias("v")).collect()}
        for text, want in cases.items():
            assert day(text, first) == got[text] == (want and date(*want)), text
    assert day("05/02/2020", "day") == date(2020, 2, 5) and day("05/02/2020", "month") == date(2020, 5, 2) and day("05/02/20", "day") == date(2020, 2, 5)
    assert day(Number("43862.75"), "day") == date(2020, 2, 1) and day(Number("42400"), "day", since_1904=True) == date(2020, 2, 1)
    assert day(Number("2020"), "day") == date(1905, 7, 12) and day(Number("20200131"), "day") == date(2020, 1, 31) and day(Number("1"), "day") == date(1900, 1, 1)
    h = Habits()
    h.see_date("05/02/2020")
    assert h.first("day") == "day"
    h.see_date("05/22/2020 10:00")
    assert h.first("day") == "month"


def test_layouts_of_csv(spark, tmp_path):
    body = [("Artikel", "1.234,50", "13.01.2020", "Müller & Söhne"), ("B", "1,250", "05.02.2020", 'quo"ted\nname')]
    head = "item;qty;grn date;supplier"
    text = "Export\n\n" + head + "\n" + "\n".join(";".join('"' + c.replace('"', '""') + '"' for c in r) for r in body) + "\n"
    want = {("Artikel", Decimal("1234.500"), date(2020, 1, 13), "Müller & Söhne"), ("B", Decimal("1.250"), date(2020, 2, 5), 'quo"ted\nname')}
    for name, encoding in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "cp1252"), ("d", "utf-16"), ("e", "utf-16-le"), ("f", "utf-16-be")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
        with open(tmp_path / f"{name}.csv", "rb") as f:
            assert encoding_of(f) == encoding
    (tmp_path / "tab.csv").write_text(text.replace(";", "\t"))
    rows, rejects = load_ledger(spark, "grn", [str(p) for p in sorted(tmp_path.glob("*.csv"))])
    got = rows.collect()
    assert len(got) == 14 and {(r.sku, r.qty, r.receipt_date, r.vendor) for r in got} == want and rejects.count() == 0


def _book(path, sheet, shared="", book=""):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        if book:
            z.writestr("xl/workbook.xml", f"<workbook {ns}>{book}</workbook>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")


def test_workbook_phonetics_errors_and_calendar(spark, tmp_path):
    shared = "<si><t>sku</t></si><si><r><t>qty</t></r></si><si><t>receipt date</t></si><si><r><t>東</t></r><r><t>京</t></r><rPh sb='0' eb='2'><t>トウキョウ</t></rPh></si>"
    sheet = (
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c r="D3" t="s"><v>2</v></c></row>'
        '<row r="4"><c r="A4" t="s"><v>3</v></c><c r="C4"><v>1.234</v></c><c r="D4"><v>42400</v></c></row>'
        '<row r="6"><c r="A6" t="e"><v>#N/A</v></c><c r="C6"><v>1</v></c><c r="D6"><v>42400</v></c></row>'
    )
    _book(tmp_path / "b.xlsx", sheet, shared, '<workbookPr date1904="1"/>')
    rows, rejects = load_ledger(spark, "grn", [str(tmp_path / "b.xlsx")], reading=Reading(mark=","))
    assert [(r.sku, r.qty, r.receipt_date, r.src_row) for r in rows.collect()] == [("東京", Decimal("1.234"), date(2020, 2, 1), 3)]
    assert [(r.reason, r.src_row) for r in rejects.collect()] == [("missing or unreadable: sku", 5)]


def test_many_unlike_files_are_one_scan_read_once(spark, tmp_path):
    n, heads = 1000, ("sku,qty,receipt date", "receipt_date;Item Code;Received Qty", "Report\nQuantity|GRN Date|Material")
    for i in range(n):
        row = {"sku": f"S{i}", "qty": str(i + 1), "date": "2020-01-05"}
        order = (("sku", "qty", "date"), ("date", "sku", "qty"), ("qty", "date", "sku"))[i % 3]
        (tmp_path / f"{i}.csv").write_text(heads[i % 3] + "\n" + (",", ";", "|")[i % 3].join(row[k] for k in order) + "\n")
    paths = [str(tmp_path / f"{i}.csv") for i in range(n)]
    plan = scan(spark, "grn", paths)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan
    rows, _ = load_ledger(spark, "grn", paths)
    for p in paths:  # nothing is read again
        (tmp_path / p).unlink()
    assert rows.agg(F.sum("qty"), F.count_distinct("sku")).first()[:] == (n * (n + 1) // 2, n)


def test_conditions_reach_the_reader(spark, tmp_path):
    (tmp_path / "g.csv").write_text("sku,qty,receipt date\nA,1,2020-01-05\nB,2,2020-02-05\nA,3,2020-03-05\n,4,2020-03-05\n")
    register(spark)
    df = spark.read.format("ledger").option("kind", "grn").load(str(tmp_path))
    some = df.where("sku = 'A' and receipt_date >= date'2020-02-01' and reason is null")
    assert [int(r.qty) for r in some.collect()] == [3]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.split("BatchScan")[0] and "sku" in plan
    assert [r.reason for r in df.where("reason is not null").collect()] == ["missing or unreadable: sku"]
    assert df.where("sku in ('B', 'C')").count() == 1 and df.where("qty > 1").count() == 2


def test_stores_that_only_spark_reads(spark, tmp_path):
    (tmp_path / "g.csv").write_text("sku,qty,receipt date\nA,1,2020-01-05\n")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.box.link./in", f"file://{tmp_path}")
    assert [(r.sku, int(r.qty)) for r in scan(spark, "grn", ["viewfs://box/in/g.csv"]).collect()] == [("A", 1)]


def test_errors_name_the_file(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    for name in ("bad.csv", "empty.csv"):
        with pytest.raises(LedgerError, match=f"{name}.*no header row"):
            load_ledger(spark, "pov", [str(tmp_path / name)])
    (tmp_path / "deep.csv").write_text("x\n" * 30 + "sku,qty,receipt date\nA,1,2020-01-05\n")
    with pytest.raises(LedgerError, match="no header"):
        load_ledger(spark, "grn", [str(tmp_path / "deep.csv")])
    assert load_ledger(spark, "grn", [str(tmp_path / "deep.csv")], reading=Reading(look_ahead=40))[0].count() == 1
