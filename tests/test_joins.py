"""Fuzzy vendors, joins on time, cubes, sketches, sessions and the SQL functions against plain versions of themselves."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from granary.functions.groups import groups
from granary.operators import fuzzy, summaries, temporal


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _names(n=160):
    rnd = random.Random(5)
    out = ["", "A", "AA", "AB", "ÄÖ", "東京商事", "東京商店"]
    for _ in range(n):
        base = "".join(rnd.choice("ABCDE") for _ in range(rnd.randint(3, 12)))
        out += [base, base[:2] + base[3:], base + rnd.choice("XYZ")]
    return out


def _grams(key, q):
    padded = "\x01" * (q - 1) + key + "\x01" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


@pytest.mark.parametrize(("hot", "percent", "q"), [(1000, 60, 2), (0, 60, 2), (5, 75, 3), (0, 20, 1)])
def test_similar_keys_are_all_pairs(spark, hot, percent, q):
    """With hot = 0 every gram is too frequent to be a key by itself."""
    names = _names()
    keys = sorted({n for n in names if n})
    want = {}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = _grams(a, q), _grams(b, q)
            if 100 * len(x & y) >= percent * len(x | y):
                want[a, b] = (len(x & y), len(x | y))
    got = fuzzy.similar_keys(spark.createDataFrame([(n,) for n in [*names, None]], "key string"), percent, q, hot)
    assert {(r.a, r.b): (r.shared, r.either) for r in got.collect()} == want and len(want) > 30


def test_frequent_grams_do_not_square_the_pairs(spark, monkeypatch):
    """Few grams, many keys: pairs of grams are frequent as well, so keys may meet only on longer combinations."""
    rnd, met = random.Random(4), []
    keys = ["".join(rnd.choice("abcd") for _ in range(14)) for _ in range(300)]
    real = fuzzy.staged
    monkeypatch.setattr(fuzzy, "staged", lambda df, name, *a: met.append((name, out := real(df, name, *a), out.count())) or out)
    fuzzy.similar_keys(spark.createDataFrame([(k,) for k in keys], "key string"), 90, 2, 5)
    assert sum(n for name, _, n in met if name in ("met", "similar")) < 300 * 5
    assert sum(name == "met" for name, _, _ in met) > 2


def test_fuzzy_vendors_of_odd_names(spark):
    rows = [(1, "Acme Trading"), (2, "ACME  trading."), (3, "Acme Tradng"), (4, "Zenith"), (5, None), (6, " -- "), (7, "Acme Tradingg"), (8, "")]
    got = {r.vendor_id: (r.group_key, r.canonical_name) for r in fuzzy.fuzzy_vendors(spark.createDataFrame(rows, "vendor_id int, vendor_name string")).collect()}
    assert {got[i] for i in (1, 2, 3, 7)} == {("ACMETRADING", "ACME  trading.")}
    assert got[4] == ("ZENITH", "Zenith") and got[5] == (None, None) and got[6][1] == " -- " and len(got) == 8
    assert fuzzy.fuzzy_vendors(spark.createDataFrame([], "vendor_id int, vendor_name string")).count() == 0


def test_groups_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300), (None, 1), (400, 401), (400, 401)]
    got = {r.node: r.label for r in groups(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200, 400: 400, 401: 400}


def test_asof_takes_the_last_row_before(spark):
    rnd = random.Random(7)
    day = lambda n: date(2020, 1, 1) + timedelta(n)
    left = [(rnd.choice(["a", "b", None, "c"]), rnd.choice([None, *map(day, range(50))]), i) for i in range(300)]
    right = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *map(day, range(60))]), rnd.choice([None, 1.5, 2.5]), i) for i in range(200)]
    x = spark.createDataFrame(left, "k string, at date, part int")
    y = spark.createDataFrame(right, "k string, seen date, v double, place int")
    got = {r.part: (r.found, r.day) for r in temporal.asof_join(x, y, ["k"], "at", "seen", {"found": "v", "day": "seen"}, tie=["place"]).collect()}
    want = {}
    for k, at, i in left:
        before = [(s, p, v) for kk, s, v, p in right if kk == k and s is not None and at is not None and s <= at]
        last = max(before, key=lambda r: r[:2], default=None)
        want[i] = (last[2], last[0]) if last else (None, None)
    assert got == want
    assert temporal.asof_join(x, y.limit(0), ["k"], "at", "seen", {"found": "v"}).where("found is not null").count() == 0


@pytest.mark.parametrize("width", [1, 7, 400])
def test_overlaps_are_all_pairs_once(spark, width):
    rnd = random.Random(8)
    day = lambda n: date(1969, 12, 1) + timedelta(n)

    def spans(n, longest):
        out = [(rnd.choice("ab"), day(a := rnd.randint(0, 60)), day(a + rnd.randint(-2, longest)), i) for i in range(n)]
        return [*out, ("a", None, day(5), -1), ("b", day(5), None, -2)]

    x, y = spans(80, 40), spans(60, 12)
    a, b = spark.createDataFrame(x, "k string, f date, t date, i int"), spark.createDataFrame(y, "k string, f2 date, t2 date, j int")
    for keys in (["k"], []):
        right = b if keys else b.drop("k")
        got = temporal.overlap_join(a, right, keys, ("f", "t"), ("f2", "t2"), width)
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
        want = sorted((p[3], q[3]) for p in x for q in y if None not in (*p[1:3], *q[1:3]) and p[1] < p[2] and q[1] < q[2] and max(p[1], q[1]) < min(p[2], q[2]) and (p[0] == q[0] or not keys))
        assert sorted((r.i, r.j) for r in got.collect()) == want


def test_cube_is_one_expand_and_tells_nulls_from_subtotals(spark):
    rows = [("v", None, 1, Decimal("2.50")), ("v", "g", 1, Decimal("1.00")), (None, "g", 2, Decimal("4.00"))]
    df = spark.createDataFrame(rows, "vendor string, item_group string, qty int, amount decimal(18,2)")
    got = summaries.spend_cube(df, ["vendor", "item_group"])
    assert plan(got).count("Expand") == 1 and plan(got).count("Exchange") == 1
    found = {(r.vendor, r.item_group, r.level): float(r.spend) for r in got.collect()}
    assert found[None, None, 3] == 7.5 and found["v", None, 1] == 3.5 and found["v", None, 0] == 2.5 and found[None, "g", 2] == 5.0 and found[None, "g", 0] == 4.0 and len(found) == 8


def test_merged_sketches_say_what_sketches_of_all_rows_say(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("uv"), rnd.randint(1, 12), f"s{rnd.randint(0, 3000)}", rnd.gauss(20, 6)) for _ in range(20_000)]
    items = spark.createDataFrame(rows, "vendor string, month int, sku string, lead_time_days double")
    by_month = summaries.vendor_sketches(items, ["vendor", "month"])
    size = by_month.agg(F.max(F.length("skus")), F.max(F.length("lead_times"))).first()
    assert size[0] < 5_000 and size[1] < 20_000
    for months in (range(1, 13), range(4, 7)):
        got = {r.vendor: r for r in summaries.told(summaries.merged(by_month.where(F.col("month").isin(list(months))), ["vendor"])).collect()}
        for vendor in "uv":
            mine = [r for r in rows if r[0] == vendor and r[1] in months]
            assert got[vendor].n_items == len(mine)
            assert abs(got[vendor].n_skus - len({r[2] for r in mine})) <= 0.05 * len({r[2] for r in mine})
            times = sorted(r[3] for r in mine)
            for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
                assert abs(sum(t <= got[vendor][name] for t in times) / len(times) - q) <= 0.01


def test_sessions_of_a_stream_and_their_late_rows(spark, tmp_path):
    from granary.streaming.fifo import closing
    from granary.streaming.sessions import late_rows, replayed_sessions, sessions

    rnd = random.Random(10)
    rows = [("s", rnd.choice("uv"), date(2020, 1, 1) + timedelta(rnd.randint(0, 300)), Decimal(rnd.randint(1, 5))) for _ in range(90)]
    grn = spark.createDataFrame(rows, "sku string, vendor string, receipt_date date, qty decimal(18,3)")
    batch = sorted(map(tuple, sessions(grn).collect()))
    out, late = replayed_sessions(spark, grn, str(tmp_path / "a"), splits=3)
    assert sorted(map(tuple, out.collect())) == batch and late == 0

    folder = str(tmp_path / "b")

    def run(df):
        df.write.mode("append").parquet(f"{folder}/grn")
        q = sessions(spark.readStream.schema(grn.schema).parquet(f"{folder}/grn")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        q = q.trigger(availableNow=True).start()
        q.awaitTermination()
        return late_rows(q)

    assert run(grn) == 0
    assert run(spark.createDataFrame([("s", "u", date(2020, 1, 1), Decimal(1))], grn.schema)) == 1  # long behind
    run(closing(spark, grn.schema, "receipt_date"))
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())) == batch


def test_functions_in_sql(spark):
    from granary.plans.sql import register_sql
    from tests.test_engines import _ledgers

    pov, grn = _ledgers(spark, 300)
    stock = spark.createDataFrame(
        [(s, date(2020, m, 28), Decimal(m)) for s in ("hot", "s1") for m in (1, 5, 9)], "sku string, as_of date, qty decimal(18,3)",
    ).withColumns({"value": F.lit(None).cast("decimal(18,2)"), "src_row": F.lit(1)})
    register_sql(spark, pov, grn, stock)
    from granary.operators.inventory import fifo_match

    got = spark.sql("SELECT * FROM fifo(TABLE(moves) PARTITION BY sku ORDER BY (move_date, src_file, src_row, line_no, vendor, qty, amount))")
    sums = lambda df: sorted((r[0], r[1], r[2], r[3]) for r in df.groupBy("sku", "order_date", "receipt_date").agg(F.sum("matched")).collect())
    assert sums(got) == sums(fifo_match(pov, grn))
    made = spark.sql("SELECT * FROM forecast('MEAN', 2, TABLE(demand) PARTITION BY sku ORDER BY t)").collect()
    assert len(made) == 2 * spark.table("demand").select("sku").distinct().count()
    with pytest.raises(Exception, match="TSB or MEAN"):
        spark.sql("SELECT * FROM forecast('x', 2, TABLE(demand) PARTITION BY sku ORDER BY t)").collect()


def test_fifo_in_sql_takes_items_whole(spark):
    """An item's rows go to Python as arrays, however many batches of Arrow they fill; null and negative quantities are left out."""
    from granary.operators.inventory import fifo_match
    from granary.plans.sql import FifoRows, register_sql
    from tests.test_engines import _ledgers

    assert FifoRows.evalType == PythonEvalType.SQL_ARROW_UDTF
    pov, grn = _ledgers(spark, 300)
    pov = pov.withColumn("qty", F.when(F.col("src_row") % 7 != 0, F.col("qty")).cast("decimal(18,3)"))
    grn = grn.withColumn("qty", F.when(F.col("src_row") % 5 == 0, F.lit(-1)).otherwise(F.col("qty")).cast("decimal(18,3)"))
    stock = spark.createDataFrame([], "sku string, as_of date, qty decimal(18,3), value decimal(18,2), src_row long")
    register_sql(spark, pov, grn, stock)
    sums = lambda df: sorted(map(str, df.groupBy("sku", "order_date", "receipt_date").agg(F.sum("matched").alias("m")).collect()))
    query = "SELECT * FROM fifo(TABLE(moves) PARTITION BY sku ORDER BY (move_date, src_file, src_row, line_no, vendor, qty, amount))"
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sums(spark.sql(query))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got and got == sums(fifo_match(pov, grn))


def test_tasks_of_sketches_follow_the_groups(spark, monkeypatch):
    """What a task sorts or sketches doesn't grow with the ledgers."""
    from granary.functions import staging
    from granary.operators import inventory
    from granary.plans import catalog
    from tests.test_engines import _ledgers

    pov, grn = _ledgers(spark, 400)
    whole = inventory.fifo_match(pov, grn)
    monkeypatch.setattr(staging, "TASK_ROWS", 20)
    dealt = inventory.fifo_match(pov, grn, None, 400)
    assert dealt.rdd.getNumPartitions() == 2 * 400 // 20 + 1
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))
    sizes, real = [], catalog.dealt
    monkeypatch.setattr(catalog, "dealt", lambda df, rows, *keys: sizes.append((rows, keys)) or real(df, rows, *keys))
    got = catalog.QUERIES["sketch_bounds"](spark, "/root/testdata/sf0.001")
    assert got.where("not (skus_ok and q1_ok and median_ok and q3_ok)").isEmpty()
    assert [k for _, k in sizes] == [("vendor", "month"), ("vendor",), ("vendor",)] and sizes[0][0] == sizes[1][0] > sizes[2][0] > 0
