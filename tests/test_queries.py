"""Every query with SQL gives DuckDB's rows on the small tables."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(row):
    return tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, int | float) else str(v) for v in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith(("op", "pipeline"))))
def test_same_as_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(plain, got.select(*cols).collect()), key=str) == sorted(map(plain, want.fetchall()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_compare_has_every_engine(spark):
    """The forest, too, beside GLM and TSB, with the values that numpy's gives for each item alone."""
    from granary.operators import forecast
    from granary.plans import catalog

    got = entry.queries()["forecast_compare"](spark, SF)
    assert got.columns == ["sku", "h", *forecast.ENGINES]
    got = {(r.sku, r.h): (r.RF, r.GLM, r.TSB) for r in got.collect()}
    assert len(got) == catalog.P.top_n * catalog.P.horizon and not any(v is None for r in got.values() for v in r)
    series = {r.sku: r.y for r in catalog.Ledgers(spark, SF).series.collect()}
    for sku in {k[0] for k in got}:
        want = forecast.forest(np.array(series[sku]), catalog.P)
        assert [got[sku, h][0] for h in range(1, catalog.P.horizon + 1)] == [round(v, 4) for v in want]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_forest_of_fractions_in_sql():
    """Sums of fractions depend on their order, and splits that are equally good on the sums' last bits."""
    from granary.operators import forecast
    from granary.plans import catalog

    con = duckdb.connect()
    for t in ("orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.execute(f"CREATE VIEW lineitem AS SELECT * REPLACE (l_quantity * 0.317 AS l_quantity) FROM read_parquet('{SF}/lineitem.parquet')")
    head = catalog._RECURSIVE + catalog._engines(0, 4) + catalog._TOP + catalog._forest()
    series = con.execute(head + " SELECT sku, y FROM series WHERE sku IN (SELECT sku FROM top)").fetchall()
    want = {(sku, h): round(v, 4) for sku, y in series for h, v in enumerate(forecast.forest(np.array(y), catalog.P), 1)}
    assert {(sku, h): v for sku, h, v in con.execute(head + " SELECT sku, h, yhat FROM rf_made").fetchall()} == want


def test_global_order(spark):
    from pyspark.sql import functions as F

    from granary.functions.ranked import with_global_order

    df = spark.range(1000).select(((F.col("id") * 37) % 1000).cast("decimal(18,2)").alias("v"))
    got = with_global_order(df, [F.col("v")], running={"run": "v"}).orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1, 1001)) and [int(r.run) for r in got] == [i * (i + 1) // 2 for i in range(1000)]


def test_stream_of_orders(spark, tmp_path):
    from granary.streaming.ledgers import stream_ledger

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("po_id,line_no,sku,vendor,order_date,qty,rate,amount\n1,1,A,V,2020-01-05,10,2,20\n2,1,,V,2020-01-05,10,2,20\n")
    q = stream_ledger(spark, "pov", str(tmp_path / "in")).writeStream.format("memory").queryName("orders_in").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.sku, int(r.qty)) for r in spark.table("orders_in").collect()] == [("A", 10)]


def test_stream_rejects_and_order_of_columns(spark, tmp_path):
    from granary.streaming.ledgers import running_value, stream_ledger, stream_rejects

    good, other = tmp_path / "good", tmp_path / "other"
    for folder in (good, other):
        folder.mkdir()
    head = "po_id,line_no,sku,vendor,order_date,qty,rate,amount"
    (good / "a.csv").write_text(f"{head}\n1,1,A,V,2020-01-05,10,2,20\n2,1,A,V,2020-01-06,1,2,oops\n3,1,A,V,2020-01-07,1,2,5\n")
    (other / "a.csv").write_text(f"{head.replace('sku,vendor', 'vendor,sku')}\n1,1,V,A,2020-01-05,10,2,20\n")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").outputMode(mode).queryName(name).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    assert [r.reason for r in run(stream_rejects(spark, "pov", str(good)), "bad_in")] == ["missing or unreadable: amount"]
    assert [float(r.value) for r in run(running_value(stream_ledger(spark, "pov", str(good))), "value_in", "complete")] == [25.0]
    with pytest.raises(Exception, match="(?i)header|STREAM_FAILED"):
        run(stream_ledger(spark, "pov", str(other)), "mixed_in")
